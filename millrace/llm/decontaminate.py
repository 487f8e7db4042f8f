"""Benchmark decontamination by size-partitioned MinHash containment search.

Question: which documents hold at least ``threshold`` of the word shingles of a benchmark item? Items are
partitioned by their number of shingles (powers of two). All items of a partition get MinHash sketches of one
length: the smallest hashes of their shingles, one more than may be missing from a document that holds
enough of them. So every such document shares at least one hash with the sketch, however long it is, and
no match is lost. Documents that meet a sketch are candidates; only for these are shingles compared as
texts and counted.

Everything is DataFrame code. The sketches and the shingles of the items are broadcast only after their rows
have been counted; above the limit both joins shuffle by hash and by shingle.

Words are runs between blanks and marks of the lower-cased text; texts of fewer words than a shingle give one
shingle of all words. Defined cases: NULL, empty and wordless texts match nothing, on either side; rows with a
NULL id are not searched, as a match could not be named; rows with one id count as one document; equal items
match separately; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of
from millrace.session import driver_rows, materialize, session_of

WORDS = 5
THRESHOLD = 0.8
# fixed values: what parts words besides blanks
MARKS = ".,;:!?\"'()[]{}<>|/\\*#$%&_=+~`^@-\t\n\r ’“”«»"


def words_of(text: Column) -> Column:
    """Array of words."""
    plain = F.translate(F.lower(text), MARKS, " " * len(MARKS))
    return F.array_remove(F.split(plain, " "), "")


def _places(words: Column, length: int) -> Column:
    """First position (from 1) of every shingle; none for no words."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(1)))).otherwise(
        F.array().cast("array<int>"))


def shingle_hashes(words: Column, length: int) -> Column:
    parts = [lambda at, k=k: F.get(words, at + (k - 1)) for k in range(length)]
    return F.transform(_places(words, length), lambda at: F.xxhash64(*[p(at) for p in parts]))


def shingle_texts(words: Column, length: int) -> Column:
    return F.transform(_places(words, length), lambda at: F.array_join(F.slice(words, at, length), " "))


def _bounded(small: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is small enough for that."""
    return F.broadcast(small) if small.count() <= driver_rows(session_of(small)) else small


def contained_items(docs: DataFrame, items: DataFrame, length: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, shingles, containment of every pair with enough of the item in the document."""
    known = items.select("item_id", words_of(text_of()).alias("words")).select(
        F.monotonically_increasing_id().alias("number"), "item_id", "words")
    known = materialize(known.where(F.size("words") > 0))
    shingles = known.select("number", F.explode(F.array_distinct(shingle_texts(F.col("words"), length))).alias("shingle"))
    hashed = known.select("number", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), length))).alias("hashes"))
    # the partition's largest item may miss this many shingles
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes"))) + 1) - 1
    depth = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    sketch = materialize(hashed.select("number", F.explode(F.slice("hashes", F.lit(1), depth)).alias("hash")))
    sizes = shingles.groupBy("number").agg(F.count("*").alias("shingles"))

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", text_of().alias("text"))
    seen = rows.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", F.explode(shingle_hashes(F.col("words"), length)).alias("hash"))
    candidates = materialize(seen.join(_bounded(sketch), "hash").select("doc_id", "number").distinct())
    suspects = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = suspects.select("doc_id", words_of(F.col("text")).alias("words")).select(
        "doc_id", F.explode(F.array_distinct(shingle_texts(F.col("words"), length))).alias("shingle"))
    met = texts.join(_bounded(materialize(shingles)), "shingle")
    counted = met.groupBy("doc_id", "number").agg(F.countDistinct("shingle").alias("shared"))
    verified = counted.join(candidates, ["doc_id", "number"], "left_semi").join(
        sizes.join(known.select("number", "item_id"), "number"), "number")
    share = F.col("shared") / F.col("shingles")
    return verified.where(share >= threshold - 1e-12).select(
        "doc_id", "item_id", "shared", "shingles", share.alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a NULL id stay.

    Items of fewer words than ``length`` are searched by shingles of their own number of words on both sides, so
    they are found inside longer documents too.
    """
    found = contained_items(docs, items, length, threshold).select("doc_id")
    sized = items.select("item_id", "text", F.size(words_of(text_of())).alias("own_words"))
    short = sized.where(F.col("own_words").between(1, length - 1))
    for row in short.select("own_words").distinct().collect():  # at most length - 1 rows
        n = row["own_words"]
        found = found.unionByName(contained_items(docs, short.where(F.col("own_words") == n), n, threshold).select("doc_id"))
    gone = found.distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
