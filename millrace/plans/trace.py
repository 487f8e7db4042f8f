"""Which node of a procedure drops which rows, for all nodes at once.

Every row carries a bit mask from the source on. A node that would drop a row sets its bit instead; rows whose
mask is zero go on. So all dropped rows with the node that dropped them come out of one pass, without an anti join per
step. The chain is followed as far as rows keep their identity: from a source through filters,
de-duplications and nodes that change columns only, up to the first join, union or aggregate.

A de-duplication keeps one row per key. Equal rows are counted as copies first, so neither a
hot key nor many equal rows meet in one task: the copies and the row to keep are found by aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import cols, quoted
from millrace.operators import filters
from millrace.plans.procedure import _NODES, Node, Procedure, ProcedureError, _Run, bind_parameters, execution_order

MASK, COPIES = "_mask", "_copies"
MOST_NODES = 63
_KEEPS_ROWS = ("clean_names", "cast", "compute", "impute", "assertion_gate", "output")


def followed(procedure: Procedure, source: str | None = None) -> list[Node]:
    """The chain from a source (default: the first one) to the last node that keeps the identity of rows."""
    order = execution_order(procedure.nodes)
    chain = [next((n for n in order if n["type"] == "source" and source in (None, n["id"])), None)]
    if chain[0] is None:
        raise ProcedureError("no such source", source)
    while True:
        after = [n for n in order if n is not chain[-1] and (n.get("inputs") or [])[:1] == [chain[-1]["id"]]]
        after = [n for n in after if len(n.get("inputs") or []) == 1]
        if len(after) != 1 or after[0]["type"] not in (*_KEEPS_ROWS, "filter", "dedupe"):
            return chain
        chain.append(after[0])


def trace_drops(procedure: Procedure, inputs: dict[str, DataFrame], params: dict[str, Any] | None = None,
                source: str | None = None) -> DataFrame:
    """The rows of a source as the followed chain leaves them, with mask, copies, dropped_by and reason.

    ``dropped_by`` is NULL for rows that reach the end of the chain; ``copies`` counts equal rows.
    """
    chain = followed(procedure, source)
    marking = [n for n in chain if n["type"] in ("filter", "dedupe")]
    if len(marking) > MOST_NODES:
        raise ProcedureError(f"a mask has room for {MOST_NODES} nodes that drop rows")
    bits = {n["id"]: 1 << i for i, n in enumerate(marking)}
    run = _Run(inputs, bind_parameters(procedure.parameters, params))
    first = _NODES["source"](run, chain[0])
    df = first.withColumns({MASK: F.lit(0).cast("long"), COPIES: F.lit(1).cast("long")})
    for node in chain[1:]:
        if node["type"] == "filter":
            df = _mark_filtered(df, node, run.params, bits[node["id"]])
        elif node["type"] == "dedupe":
            df = _mark_repeated(df, node, bits[node["id"]])
        elif node["type"] == "clean_names":
            run.frames, run.last = {"_": df.drop(MASK, COPIES)}, "_"
            names = _NODES["clean_names"](run, {**node, "inputs": []}).columns
            df = df.toDF(*names, MASK, COPIES)
        elif node["type"] in ("cast", "compute"):
            run.frames, run.last = {"_": df}, "_"
            changed = _NODES[node["type"]](run, {**node, "inputs": []})
            df = changed.select(*cols(n for n in changed.columns if n not in (MASK, COPIES)), MASK, COPIES)
        elif node["type"] == "impute":
            # fills are fitted on the rows that are still there
            run.frames, run.last = {"_": df.where(F.col(MASK) == 0)}, "_"
            run.settled.pop(node["id"], None)
            _NODES["impute"](run, {**node, "inputs": []})
            run.frames = {"_": df}
            df = _NODES["impute"](run, {**node, "inputs": []})
    lowest = F.col(MASK).bitwiseAND(-F.col(MASK))
    blame = F.coalesce(*[F.when(lowest == bit, name) for name, bit in bits.items()], F.lit(None).cast("string"))
    words = {n["id"]: "does not match the filter" if n["type"] == "filter" else "repeats a key" for n in marking}
    why = F.coalesce(*[F.when(F.col("dropped_by") == n, w) for n, w in words.items()], F.lit(None).cast("string"))
    return df.withColumn("dropped_by", blame).withColumn("reason", why).withColumnRenamed(MASK, "mask").withColumnRenamed(
        COPIES, "copies")


def _alive(test: Column) -> Column:
    return (F.col(MASK) == 0) & test


def _mark_filtered(df: DataFrame, node: Node, params: dict[str, Any], bit: int) -> DataFrame:
    passes = F.lit(True)
    for rule in node["config"].get("rules", []):
        value = params.get(rule["param"]) if "param" in rule else rule.get("val")
        passes = passes & filters.sql_predicate(df, rule["col"], rule.get("op", "="), value)
    fails = ~F.coalesce(passes, F.lit(False))
    return df.withColumn(MASK, F.when(_alive(fails), F.lit(bit)).otherwise(F.col(MASK)).cast("long"))


def _mark_repeated(df: DataFrame, node: Node, bit: int) -> DataFrame:
    config = node.get("config") or {}
    names = [n for n in df.columns if n not in (MASK, COPIES)]
    subset, order = list(config.get("subset") or names), list(config.get("order_by") or ())
    rest = [n for n in names if n not in subset]
    ranked = [*order, *[n for n in rest if n not in order]]
    once = df.groupBy(*cols(names), MASK).agg(F.sum(COPIES).alias(COPIES))
    rank = F.struct(*cols(ranked)) if ranked else F.struct(F.lit(0))
    kept = once.where(F.col(MASK) == 0).groupBy(*cols(subset)).agg(F.min(rank).alias("_kept"))
    kept = kept.toDF(*[f"_k{i}" for i in range(len(subset))], "_kept")
    on = [once[quoted(n)].eqNullSafe(kept[f"_k{i}"]) for i, n in enumerate(subset)]
    met = once.join(kept, on, "left")
    stays = (F.col(MASK) == 0) & rank.eqNullSafe(F.col("_kept"))
    shares = F.when(stays, F.array(
        F.struct(F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("c")),
        F.struct(F.lit(bit).cast("long").alias("m"), (F.col(COPIES) - 1).alias("c"))))
    shares = shares.otherwise(F.array(F.struct(
        F.when(F.col(MASK) == 0, F.lit(bit)).otherwise(F.col(MASK)).cast("long").alias("m"), F.col(COPIES).alias("c"))))
    return met.select(*cols(names), F.inline(shares)).where("c > 0").withColumnRenamed("m", MASK).withColumnRenamed("c", COPIES)


def dropped(traced: DataFrame) -> DataFrame:
    """Side output: only the dropped rows."""
    return traced.where(F.col("dropped_by").isNotNull())


def drop_counts(traced: DataFrame, nodes: Sequence[str] = ()) -> DataFrame:
    """Rows dropped by each node."""
    found = dropped(traced).groupBy("dropped_by", "reason").agg(F.sum("copies").alias("n_rows"))
    return found.where(F.col("dropped_by").isin(list(nodes))) if nodes else found
