"""SimHash near-duplicates found by pigeonhole blocks.

A text's fingerprint has 64 bits; a bit is 1 if more than half of the XXH64 values of its word
shingles have it. Fingerprints that differ in at most ``distance`` bits are linked, and documents in
one connected component form a group.

Candidates: with ``distance + 2`` blocks of bits, two close fingerprints agree in at least two whole
blocks, so they meet under one of the block pairs (32 bits each for distance 2, so keys stay selective
at any size). Only distinct fingerprints meet; documents join their fingerprint's component at the end,
so copies are never paired. Under a key with few members all are compared and verified. Under a crowded
key (many near copies of one text) members are re-keyed by the key and every value within one bit of
their remaining bits: two of them differ in two bits or less exactly if they share such a value, and at
most 33 can share one, so no group grows and no link is lost. Each such value links its members to the
least one.

Defined cases: NULL and white space give fingerprint 0, linked like any other; fewer words than a
shingle give one shingle of all words; equal ids are one document if their fingerprints are linked;
rows with a NULL id get a fingerprint and, as component, the least id reached (NULL if none has one).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of
from millrace.llm.graph import components
from millrace.session import materialize

BITS = 64
CROWDED = 24
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits over the XXH64 values of the word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1:].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        piece = hashes[at: at + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, digest: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, with a hash of the whole text if asked for."""
    more = ["digest"] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                marks = [fingerprint(t, words) for t in part.column("text").cast(pa.binary()).to_pylist()]
                signed = pa.array(np.array(marks, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), signed, *map(part.column, more)], names=["doc_id", "fp", *more])

    rows = docs.select("doc_id", text_of().alias("text"), *[F.xxhash64(text_of()).alias(m) for m in more])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long" + "".join(f", {m} long" for m in more))


def _masks(distance: int) -> list[int]:
    """Bits of every pair of blocks; ``distance`` differing bits leave two of the blocks untouched."""
    blocks = distance + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [block[i] | block[j] for i, j in combinations(range(blocks), 2)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(marks: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints within ``distance`` (at most 2) bits."""
    if distance != 2:
        raise ValueError("crowded keys are split for a distance of 2 bits only")
    masks = _masks(distance)
    keys = F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for i, m in enumerate(masks)])
    keyed = marks.select("fp", F.explode(keys).alias("key")).select("fp", "key.part", "key.bits")
    sizes = keyed.groupBy("part", "bits").count().where("count > 1")
    met = materialize(keyed.join(sizes, ["part", "bits"]))
    few = met.where(F.col("count") <= CROWDED).select("part", "bits", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["part", "bits"]).where(
        (F.col("a") < F.col("b")) & (_differ(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    crowd = met.where(F.col("count") > CROWDED)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(BITS)])
    open_bits = F.element_at(F.array(*[F.lit(_signed(~m & ((1 << BITS) - 1))) for m in masks]), F.col("part") + 1)
    near = crowd.select("fp", "part", F.explode(flips).alias("flip")).where(
        F.col("flip").bitwiseAND(open_bits) == F.col("flip")).select(
        "part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("part", "value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(least, ["part", "value"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    found = materialize(fingerprints(docs, words))
    return found.join(named_marks(found, distance), "fp", "left").select("doc_id", "fp", "component_id")


def named_marks(found: DataFrame, distance: int) -> DataFrame:
    """fp, root (one mark for each group) and component_id of every distinct mark."""
    marks = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(marks.select("fp"), distance)).withColumnRenamed("node", "fp")
    # of each mark that is alone the root is itself; only marks move here, one row for each
    rooted = marks.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without those of a group that are not its least id; NULL ids stay.

    Groups are those of ``simhash_groups``. Where several rows have one id, each group keeps one row of its
    least id, whatever groups the other rows of that id are in.
    """
    found = materialize(fingerprints(docs, words, digest=True).where("doc_id IS NOT NULL"))
    groups = materialize(found.join(named_marks(found, distance), "fp"))
    again = materialize(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = groups.where("component_id < doc_id").select("doc_id")
    once = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return once
    own = "digest"
    while own in docs.columns:
        own += "_"
    least = groups.where("component_id = doc_id").join(again, "doc_id", "left_semi")
    chosen = least.groupBy("root", "doc_id").agg(F.min("digest").alias(own)).select("doc_id", own)
    repeated = docs.join(again, "doc_id", "left_semi").withColumn(own, F.xxhash64(text_of()))
    kept = repeated.join(chosen, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(kept.select(docs.columns))
