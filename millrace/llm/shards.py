"""Minimax contiguous partition of documents into shards.

Copies of one text form an atomic group. Groups stand in the order of their content digest; the
smallest capacity at which a greedy sweep needs no more than the wanted shards is found by binary
search, and the greedy sweep at that capacity gives the cuts. A group that alone exceeds the mean of
what is left gets a shard of its own first, so the others stay near equal.

The sweep never needs all groups in one place. The driver holds subtotals of digest ranges and only
splits those ranges further in which a cut can fall for any capacity still possible; it stops when
every such range is a single group, so the capacity is exact. Slots inside a shard are numbered per
block of (shard, digest prefix, salt of the id) plus the block's offset, so no task sees a shard whole
and a group that holds a third of all rows is spread over the salts.

Defined cases: NULL counts as the empty text; rows with equal ids each get a slot; an empty table
gives an empty result; more shards than groups leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_of
from millrace.session import materialize

ROW_BYTES = 8
FIRST_PREFIX = 3
BLOCK_PREFIX = 2
BLOCK_ROWS = 200_000
LEAST_SALTS = 16


def _sweep(sizes: list[int], ends: list[int], capacity: int) -> list[int]:
    """First index of every shard when each takes as much as fits; ``ends`` are running totals."""
    starts, at, done = [], 0, 0
    while at < len(sizes):
        starts.append(at)
        at = bisect_right(ends, done + capacity, at)
        done = ends[at - 1]
        if at == starts[-1]:
            return starts + [at] * len(sizes)
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least capacity at which the sweep over ``sizes`` needs at most ``shards`` shards."""
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if len(_sweep(sizes, ends, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _open_ranges(segments: list[tuple], low: int, high: int, shards: int) -> list[str]:
    """Prefixes of the ranges of several groups in which a cut may fall for a capacity in [low, high]."""
    ends = list(accumulate(s[1] for s in segments))
    wanted, early, late = set(), 0, 0
    for _ in range(shards):
        reached = bisect_right(ends, early + low)
        early = ends[reached - 1] if reached and ends[reached - 1] > early else early
        late = min(late + high, ends[-1])
        first, last = bisect_right(ends, early), bisect_right(ends, late)
        wanted.update(s[0] for s in segments[first: last + 1] if s[2] > 1)
    return sorted(wanted)


def contiguous_cuts(groups: DataFrame, shards: int) -> list[str]:
    """First digest of every shard for ``groups`` (content, bytes) in digest order."""
    length = FIRST_PREFIX

    def subtotals(part: DataFrame) -> list[tuple]:
        key = F.substring("content", 1, length).alias("prefix")
        rows = part.groupBy(key).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
        return [tuple(r) for r in rows]

    segments = sorted(subtotals(groups))
    if not segments:
        return []
    largest = max(s[3] for s in segments)
    while True:
        sizes = [s[1] for s in segments]
        high = smallest_capacity(sizes, shards)
        low = max(largest, -(-sum(sizes) // shards))
        split = _open_ranges(segments, low, high, shards)
        if not split:
            starts = _sweep(sizes, list(accumulate(sizes)), high)
            return [segments[i][0] for i in starts]
        held: dict[int, list[str]] = {}
        for prefix in split:
            held.setdefault(len(prefix), []).append(prefix)
        gone = set(split)
        segments = [s for s in segments if s[0] not in gone]
        for width, prefixes in held.items():
            length = width + 1
            segments += subtotals(groups.where(F.substring("content", 1, width).isin(prefixes)))
        segments.sort()


def minimax_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, content for every row of ``docs`` (doc_id, text)."""
    text = text_of()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("content"))
    groups = materialize(rows.groupBy("content").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    alone: list[str] = []
    for content, size, _ in groups.orderBy(F.desc("bytes"), "content").limit(shards).collect():
        if len(alone) == shards - 1 or size * (shards - len(alone)) <= total:
            break
        alone.append(content)
        total -= size
    cuts = contiguous_cuts(groups.where(~F.col("content").isin(alone)) if alone else groups, shards - len(alone))
    swept = F.lit(len(alone) - 1)
    for cut in cuts:
        swept = swept + (F.col("content") >= cut).cast("int")
    shard = F.greatest(swept, F.lit(0))
    for place, content in enumerate(alone):
        shard = F.when(F.col("content") == content, place).otherwise(shard)
    salts = max(LEAST_SALTS, -(-n // (16 ** BLOCK_PREFIX * BLOCK_ROWS)))
    block = ["shard", "prefix", "salt"]
    placed = rows.withColumns({
        "shard": shard.cast("int"), "prefix": F.substring("content", 1, BLOCK_PREFIX),
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    before = Window.partitionBy("shard").orderBy("prefix", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(block).agg(F.count("*").alias("held")).select(
        *block, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    turn = F.row_number().over(Window.partitionBy(block).orderBy("content", "doc_id"))
    return placed.withColumn("turn", turn).join(offsets, block).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("turn") - 1).cast("long").alias("slot"), "content")
