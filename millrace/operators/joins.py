"""Join chains over named tables with pre-join rollups, filters and collision-free output names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, cols, quoted, require
from millrace.operators.filters import join_predicate
from millrace.sources.workspace import table_name

_HOW = {
    "INNER": "inner",
    "LEFT": "left",
    "RIGHT": "right",
    "FULL": "full",
    "SEMI": "left_semi",
    "ANTI": "left_anti",
    "CROSS": "cross",
}
_EXISTENCE = ("left_semi", "left_anti")
_ROLLUP = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
           "COUNT_DISTINCT": F.count_distinct}


@dataclass
class JoinSpec:
    """base table, then joins in order; filters apply to the joined rows."""

    base: str
    joins: Sequence[dict[str, Any]] = ()
    columns: Sequence[str] | None = None
    filters: Sequence[dict[str, Any]] = ()
    rollups: Sequence[dict[str, Any]] = field(default_factory=list)


def join_kind(word: str | None) -> str:
    """Spark join type; an unknown word means a left join."""
    return _HOW.get(str(word or "LEFT").upper().strip(), "left")


def rollup(df: DataFrame, table: str, spec: dict[str, Any]) -> DataFrame:
    """Aggregate a table before it is joined."""
    keys = [str(k).strip() for k in spec.get("group_by", [])]
    measures = []
    for item in spec.get("aggregates", []):
        name = str(item.get("column", "")).strip()
        word = str(item.get("function", "COUNT")).upper().strip()
        if word not in _ROLLUP:
            continue
        alias = item.get("alias") or f"{table}_{word.lower()}_{name}"
        measures.append(_ROLLUP[word](col(name)).alias(alias))
    if not measures:
        return df.select(*cols(keys)).distinct()
    return df.groupBy(*cols(keys)).agg(*measures) if keys else df.agg(*measures)


def _field(table: str, name: str) -> Column:
    return F.col(quoted(f"{table}.{name}"))


def _labelled(df: DataFrame, table: str) -> DataFrame:
    """Columns named ``table.column``, so no two tables of a join share a name."""
    return df.toDF(*[f"{table}.{n}" for n in df.columns])


def _joined(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    """A join; a full outer one as matches and what either side has left.

    Spark splits hot keys of inner and anti joins at run time, but not of a full outer join. All three
    parts read the same two shuffles.
    """
    if how != "full":
        return left.join(right, on, how)
    alone = left.join(right, on, "left_anti"), right.join(left, on, "left_anti")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alone, left.join(right, on, "inner"))


def run_join(tables: dict[str, DataFrame], spec: JoinSpec) -> DataFrame:
    tables = {table_name(n): d for n, d in tables.items()}
    base = table_name(spec.base)
    if base not in tables:
        raise ValueError(f"base table {spec.base!r} not found")
    rollups = [*spec.rollups, *[j["rollup"] for j in spec.joins if j.get("rollup")]]
    frames = dict(tables)
    for item in rollups:
        name = table_name(item.get("table"))
        if name in frames:
            frames[name] = rollup(tables[name], name, item)

    steps = [j for j in spec.joins if table_name(j.get("table")) in frames]
    hidden = {table_name(j["table"]) for j in steps if join_kind(j.get("join_type")) in _EXISTENCE}
    tests: dict[str, list[Column]] = {}
    for rule in spec.filters:
        name = table_name(rule.get("table"))
        if name not in frames or not rule.get("column"):
            continue
        target = _field(name, str(rule["column"]).strip())
        test = join_predicate(target, str(rule.get("operator", "=")), rule.get("value"))
        if test is not None:
            tests.setdefault(name, []).append(test)

    out = _labelled(frames[base], base)
    shown = [base]
    for step in steps:
        name, how = table_name(step["table"]), join_kind(step.get("join_type"))
        right = _labelled(frames[name], name)
        if name in hidden:
            right = reduce(lambda d, t: d.where(t), tests.pop(name, []), right)
        pairs = [
            _field(table_name(c.get("left_table") or base), c["left_col"]) == _field(name, c["right_col"])
            for c in step.get("conditions", [])
            if c.get("left_col") and c.get("right_col")
        ]
        if not pairs and how != "cross":
            raise ValueError(f"the join with {name!r} has no condition; ask for CROSS if every pair is wanted")
        if how == "cross":
            out = out.crossJoin(right)
        else:
            out = _joined(out, right, reduce(lambda a, b: a & b, pairs), how)
        if name not in hidden and name not in shown:
            shown.append(name)
    for items in tests.values():
        out = reduce(lambda d, t: d.where(t), items, out)

    uses = Counter(n for t in shown for n in frames[t].columns)
    picks = []
    for name in shown:
        for column in frames[name].columns:
            alias = f"{name}_{column}" if uses[column] > 1 else column
            if spec.columns and alias not in spec.columns and column not in spec.columns:
                continue
            picks.append(_field(name, column).alias(alias))
    return out.select(*picks)


def preview_join(tables: dict[str, DataFrame], spec: JoinSpec, limit: int = 50) -> tuple[DataFrame, int]:
    joined = run_join(tables, spec)
    return joined.limit(limit), joined.count()


def join_two(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, join_type: str = "INNER"
) -> DataFrame:
    """Two-input join that outputs all left columns and the right ones without the right key."""
    require(left, [left_on])
    require(right, [right_on])
    how = join_kind(join_type)
    taken = {n.lower() for n in left.columns}
    extra = [n for n in right.columns if n != right_on]
    named = {n: f"right_{n}" if n.lower() in taken else n for n in extra}
    lhs, rhs = _labelled(left, "l"), _labelled(right, "r")
    condition = _field("l", left_on) == _field("r", right_on)
    joined = lhs.crossJoin(rhs) if how == "cross" else _joined(lhs, rhs, condition, how)
    picks = [_field("l", n).alias(n) for n in left.columns]
    if how not in _EXISTENCE:
        picks += [_field("r", n).alias(named[n]) for n in extra]
    return joined.select(*picks)
