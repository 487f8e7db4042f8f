"""Near-equal text labels mapped to one spelling.

Two labels are linked when their difflib ratio reaches the threshold; linked groups share the
longest label. Candidate pairs come from an exact filter: a ratio of t means the labels share at
least t·(|a|+|b|)/2 characters, so among the rarest characters of both at least ``depth`` must
coincide (prefix filtering; Bayardo, Ma and Srikant 2007, with the deeper prefixes of Wang, Li and
Feng 2012). Labels meet only on such key combinations, and the combination is made longer while any
key is common to more labels than a task should pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import col
from millrace.session import materialize

MAX_DEPTH = 4
CROWDED = 256


def _occurrences(text: str) -> list[str]:
    """Characters tagged with their occurrence number, so a multiset becomes a set."""
    seen: dict[str, int] = {}
    out = []
    for mark in text:
        seen[mark] = seen.get(mark, 0) + 1
        out.append(f"{mark}{seen[mark]}")
    return out


def _keys(labels: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(label, key): every ``depth``-combination of the rarest tagged characters of a label."""

    @F.pandas_udf("array<string>")
    def tagged(texts: pd.Series) -> pd.Series:
        return texts.map(_occurrences)

    tokens = labels.withColumn("tokens", tagged("label"))
    common = tokens.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = (
        tokens.select("label", F.explode("tokens").alias("token"))
        .join(common, "token")
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("ranked"))
    )
    share = threshold / (2.0 - threshold)

    @F.pandas_udf("array<string>")
    def combine(ordered: pd.Series) -> pd.Series:
        def needed(size):
            return max(1, math.ceil(size * share - 1e-9))

        def pick(tokens):
            size, out = len(tokens), []
            # a partner of another length may meet this label on a shorter or longer combination
            partners = range(math.ceil(size * share - 1e-9), math.floor(size / share + 1e-9) + 1)
            for level in {min(depth, needed(p)) for p in partners if p > 0}:
                head = tokens[: size - needed(size) + level]
                out += ["\x1f".join(c) for c in combinations(head, level)]
            return out

        return ordered.map(pick)

    names = F.transform("ranked", lambda r: r["token"])
    return ranked.select("label", F.explode(combine(names)).alias("key"))


def similar_pairs(labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, ratio) for labels a < b whose difflib ratio reaches the threshold."""
    for depth in range(1, MAX_DEPTH + 1):
        keyed = _keys(labels, threshold, depth)
        crowd = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if crowd <= CROWDED:
            break
    left, right = keyed.toDF("a", "key"), keyed.toDF("b", "key")
    sizes = F.length("a") + F.length("b")
    shorter = 2 * F.least(F.length("a"), F.length("b"))
    # a label pair of very different lengths cannot reach the ratio
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (shorter >= threshold * sizes))

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for firsts, seconds in parts:
            yield pd.Series([
                max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
                for a, b in zip(firsts, seconds)
            ])

    return pairs.select("a", "b").distinct().withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= threshold)


def _better(a: str) -> Column:
    """Sort key: longer labels first, then alphabetical."""
    return F.struct((-F.length(a)).alias("size"), F.col(a).alias("text"))


def canonical_labels(labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(label, canonical) for every label of a linked group.

    Each round a label takes the best name among its own, its neighbours' and its name's name, so
    the rounds grow with the logarithm of a chain's length. Minimum aggregates combine map-side.
    """
    pairs = similar_pairs(labels, threshold)
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = edges.select(F.col("a").alias("label")).distinct().withColumn("best", _better("label"))
    while True:
        near = edges.join(names.select(F.col("label").alias("b"), "best"), "b").select(F.col("a").alias("label"), "best")
        hop = names.select("label", F.col("best.text").alias("via")).join(
            names.select(F.col("label").alias("via"), "best"), "via").select("label", "best")
        every = names.unionByName(near).unionByName(hop)
        fresh = materialize(every.groupBy("label").agg(F.min("best").alias("best")))
        changed = fresh.join(names.withColumnRenamed("best", "old"), "label").where("best.text <> old.text").limit(1)
        done = changed.count() == 0
        names = fresh
        if done:
            return names.select("label", F.col("best.text").alias("canonical"))


def fuzzy_dedupe(df: DataFrame, name: str, threshold: float = 0.85) -> DataFrame:
    """Replace each value by the canonical label of its group."""
    labels = df.select(col(name).alias("label")).where("label IS NOT NULL").distinct()
    table = canonical_labels(materialize(labels), threshold).where("label <> canonical")
    joined = df.join(table, col(name) == F.col("label"), "left")
    return joined.withColumn(name, F.coalesce(F.col("canonical"), col(name))).select(*[col(n) for n in df.columns])
