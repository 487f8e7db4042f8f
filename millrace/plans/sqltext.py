"""A procedure written out as one Spark SQL query of common table expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from millrace.columns import distinct_names, quoted, snake
from millrace.functions.formula import formula_sql
from millrace.operators.joins import join_kind
from millrace.plans.procedure import Node, Procedure, _Run, _NODES, bind_parameters, execution_order

_WORDS = {"inner": "INNER JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL OUTER JOIN",
          "left_semi": "LEFT SEMI JOIN", "left_anti": "LEFT ANTI JOIN", "cross": "CROSS JOIN"}


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value) + ("D" if isinstance(value, float) else "")
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"



def _where(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    tests = []
    for rule in node["config"].get("rules", []):
        op = rule.get("op", "=").upper()
        value = params.get(rule["param"]) if "param" in rule else rule.get("val")
        tail = "" if op in ("IS NULL", "IS NOT NULL") else " " + literal(value)
        tests.append(f"{quoted(rule['col'])} {op}{tail}")
    return f"SELECT * FROM {parents[0]} WHERE {' AND '.join(tests) or 'TRUE'}"


def _renamed(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    casing = node.get("config", {}).get("casing", "snake_case")
    rule = {"snake_case": snake, "uppercase": lambda n: n.strip().upper(),
            "lowercase": lambda n: n.strip().lower()}.get(casing, str.strip)
    new = distinct_names([rule(n) for n in frames[0].columns])
    picks = ", ".join(f"{quoted(a)} AS {quoted(b)}" for a, b in zip(frames[0].columns, new))
    return f"SELECT {picks} FROM {parents[0]}"


def _filled(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    rules = node["config"].get("columns", {})
    stats = {"mean": "avg", "median": "median", "mode": "mode"}
    picks = []
    for name in frames[0].columns:
        rule, c = rules.get(name), quoted(name)
        method = rule.get("strategy", "median") if rule else None
        if method == "constant":
            picks.append(f"coalesce({c}, {literal(rule.get('value', ''))}) AS {c}")
        elif method == "zero":
            picks.append(f"coalesce({c}, 0) AS {c}")
        elif method in stats:
            picks.append(f"coalesce({c}, (SELECT {stats[method]}({c}) FROM {parents[0]})) AS {c}")
        else:
            picks.append(c)
    return f"SELECT {', '.join(picks)} FROM {parents[0]}"


def _grouped(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    keys = [quoted(k) for k in node["config"].get("group_by", [])]
    picks = list(keys)
    for m in node["config"].get("metrics", []):
        argument = "*" if m["col"] == "*" else quoted(m["col"])
        picks.append(f"{m['agg']}({argument}) AS {quoted(m.get('alias', m['agg'] + '_' + m['col']))}")
    tail = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {', '.join(picks)} FROM {parents[0]}{tail}"


def _distinct(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    subset = node.get("config", {}).get("subset") or []
    rest = [n for n in frames[0].columns if n not in subset]
    if not subset or not rest:
        return f"SELECT DISTINCT * FROM {parents[0]}"
    first = [n for n in node.get("config", {}).get("order_by") or []]
    ranked = [*first, *[n for n in rest if n not in first]]
    keys = ", ".join(quoted(n) for n in subset)
    row = "min(struct(" + ", ".join(quoted(n) for n in ranked) + ")) AS _row"
    picks = ", ".join(quoted(n) if n in subset else f"_row.{quoted(n)}" for n in frames[0].columns)
    return f"SELECT {picks} FROM (SELECT {keys}, {row} FROM {parents[0]} GROUP BY {keys})"


def _cast(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    casts = node["config"].get("casts", {})
    words = {"VARCHAR": "STRING", "TEXT": "STRING"}
    picks = [
        f"CAST({quoted(n)} AS {words.get(casts[n].upper(), casts[n])}) AS {quoted(n)}" if n in casts else quoted(n)
        for n in frames[0].columns
    ]
    return f"SELECT {', '.join(picks)} FROM {parents[0]}"


def _joined(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    config = node["config"]
    how = join_kind(config.get("join_type", "INNER"))
    left, right = frames
    taken = {n.lower() for n in left.columns}
    picks = [f"l.{quoted(n)}" for n in left.columns]
    if how not in ("left_semi", "left_anti"):
        for name in right.columns:
            if name != config["right_on"]:
                alias = f"right_{name}" if name.lower() in taken else name
                picks.append(f"r.{quoted(name)} AS {quoted(alias)}")
    on = "" if how == "cross" else f" ON l.{quoted(config['left_on'])} = r.{quoted(config['right_on'])}"
    return f"SELECT {', '.join(picks)} FROM {parents[0]} l {_WORDS[how]} {parents[1]} r{on}"


def _computed(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    name = quoted(node["config"]["derived_column"])
    formula = formula_sql(frames[0], node["config"]["sql_expression"])
    there = [n.lower() for n in frames[0].columns]
    picks = [f"({formula}) AS {name}" if n.lower() == node["config"]["derived_column"].lower() else quoted(n)
             for n in frames[0].columns]
    if node["config"]["derived_column"].lower() not in there:
        picks.append(f"({formula}) AS {name}")
    return f"SELECT {', '.join(picks)} FROM {parents[0]}"


def _united(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    names: list[str] = []
    for frame in frames:
        names += [n for n in frame.columns if n not in names]
    parts = []
    for parent, frame in zip(parents, frames):
        picks = [quoted(n) if n in frame.columns else f"NULL AS {quoted(n)}" for n in names]
        parts.append(f"SELECT {', '.join(picks)} FROM {parent}")
    return " UNION ALL ".join(parts)


def _same(node: Node, parents: list[str], frames: list[DataFrame], params: dict[str, Any]) -> str:
    return f"SELECT * FROM {parents[0]}"


_TEXT: dict[str, Callable[..., str]] = {
    "clean_names": _renamed, "filter": _where, "impute": _filled, "compute": _computed, "aggregate": _grouped,
    "dedupe": _distinct, "cast": _cast, "join": _joined, "union": _united, "assertion_gate": _same, "output": _same,
}


def procedure_sql(
    procedure: Procedure, inputs: dict[str, DataFrame], params: dict[str, Any] | None = None
) -> str:
    """SQL with the same result as the procedure; inputs are views of the same names.

    Formulas are written out from their parsed tree, so they mean what they mean in the procedure.
    """
    bound = bind_parameters(procedure.parameters, params)
    run = _Run(inputs, bound)
    clauses, last = [], None
    for node in execution_order(procedure.nodes):
        name = quoted(f"step_{snake(node['id'])}")
        if node["type"] == "source":
            frame = _NODES["source"](run, node)
            view = next(k for k, v in inputs.items() if v is frame)
            body = f"SELECT * FROM {quoted(view)}"
        else:
            parents = node.get("inputs") or [last]
            frames = [run.frames[p] for p in parents]
            body = _TEXT[node["type"]](node, [quoted(f"step_{snake(p)}") for p in parents], frames, bound)
            frame = frames[0] if node["type"] == "assertion_gate" else _NODES[node["type"]](run, node)
        run.frames[node["id"]] = frame
        run.last = last = node["id"]
        clauses.append(f"{name} AS (\n  {body}\n)")
    return "WITH " + ",\n".join(clauses) + f"\nSELECT * FROM {quoted(f'step_{snake(last)}')}"
