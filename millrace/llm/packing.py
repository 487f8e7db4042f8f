"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt out at random (by a hash of their id) to parts of about ``part_rows`` pieces; every
part is packed by one task, so packing needs one shuffle of ids and sizes and no text. In a part the
pieces come largest first. Bins are kept in the order of their free room and carry two bitmaps, of the
sources and of the duplicate clusters they hold. The search starts at the first bin with enough room and
goes on to the next one until the tightest bin without a conflict is found; only then a bin is opened.

Duplicate clusters are the SimHash groups of ``with_clusters`` where its columns are given (as ``op10_packing``
does for raw documents), else texts that are equal up to case.

A text longer than a bin is cut into byte ranges: full bins and a rest, which is packed like a text.

Defined cases: NULL texts have size 0 and still get a bin; a NULL source conflicts with nothing; NULL
ids are packed as one id; equal rows are copies, so they never share a bin; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of
from millrace.llm.simhash import fingerprints, named_marks
from millrace.session import materialize

CAPACITY = 8_192
PART_ROWS = 2_048
BIN_SHIFT = 1 << 32


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every piece in the given order; sources and clusters are bitmaps of what conflicts."""
    order: list[tuple[int, int]] = []  # (free room, bin)
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        at = bisect_left(order, (size, -1))
        while at < len(order):
            own_sources, own_clusters = held[order[at][1]]
            if not (own_sources & source or own_clusters & cluster):
                break
            at += 1
        if at < len(order):
            room, number = order.pop(at)
            held[number] = (own_sources | source, own_clusters | cluster)
        else:
            room, number = capacity, len(held)
            held.append((source, cluster))
        bins.append(number)
        offsets.append(capacity - room)
        insort(order, (room - size, number))
    return bins, offsets


def _bits(values: pd.Series) -> list[int]:
    """One bit for each value that occurs more than once; what occurs once cannot conflict."""
    times = Counter(v for v in values if not pd.isna(v))
    place = {v: 1 << i for i, v in enumerate(v for v, n in times.items() if n > 1)}
    return [0 if pd.isna(v) else place.get(v, 0) for v in values]


def with_clusters(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, source, size and near_copies (the SimHash group of its text) of every row, without the texts."""
    found = materialize(fingerprints(docs, words, digest=True).select("digest", "fp").distinct())
    named = named_marks(found.select("fp", F.lit(None).cast("long").alias("doc_id")), distance)
    groups = found.join(named, "fp").select("digest", F.col("root").alias("near_copies"))
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", source.cast("string").alias("source"), F.octet_length(text_of()).cast("long").alias("size"),
                       F.xxhash64(text_of()).alias("digest"))
    return rows.join(groups, "digest", "left").drop("digest")


def pack(docs: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, size: Column | None = None,
         cluster: Column | None = None, keep_sources_apart: bool = True) -> DataFrame:
    """doc_id, piece, pieces, start, size, bin_id, bin_offset for every piece of every row of ``docs``.

    Size counts UTF-8 bytes unless another column says how large a row is; copies are texts that are equal
    up to case unless ``cluster`` says otherwise.
    """
    size = F.octet_length(text_of()) if size is None else size
    cluster = F.xxhash64(F.lower(text_of())) if cluster is None else cluster
    source = F.col("source") if keep_sources_apart and "source" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", source.cast("string").alias("source"), size.cast("long").alias("whole"),
                       cluster.alias("cluster"))
    pieces = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1)).cast("int")
    n = rows.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    parts = max(1, -(-n // part_rows))
    cut = rows.withColumn("pieces", pieces).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({
            "start": F.col("piece").cast("long") * capacity,
            "part": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))})
    cut = cut.withColumn("size", F.least(F.col("whole") - F.col("start"), F.lit(capacity)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True])
        bins, offsets = best_fit(group["size"].tolist(), _bits(group["source"]), _bits(group["cluster"]), capacity)
        group["bin_id"] = [int(p) * BIN_SHIFT + b for p, b in zip(group["part"], bins)]
        group["bin_offset"] = offsets
        return group[["doc_id", "piece", "pieces", "start", "size", "bin_id", "bin_offset"]]

    return cut.groupBy("part").applyInPandas(
        packed, f"doc_id {kind}, piece int, pieces int, start long, size long, bin_id long, bin_offset long")
