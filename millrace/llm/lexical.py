"""Ranked lexical search with posting lists in geometric blocks.

Documents are searched where they are: every task cuts its documents into shards, so no posting is
shuffled, and only its best rows of each item leave it. A shard's posting list of a term is clustered by the
similarity of its documents (cosine of random-sign projections of their term weights). Each block keeps the
coordinatewise maximum of its documents' weights as a summary; the shard's own maximum is the summary of all
its lists.

The terms of an item are taken from the rarest to the most common one. A document belongs to the list of the
first of these terms that it holds, so in the list of a term only the weights of that term and of more common
ones count towards a bound, and no document is scored twice. A list, or a block of it, is skipped only when the
inner product of item and summary is below the k-th best score so far; documents of all other blocks are
scored in full. All weights are whole numbers, so bounds are exact upper bounds. The first k-th best scores
come from a search among about ``SAMPLE`` documents, drawn by a hash of the id; any documents' scores are valid for that.

Two passes read the texts' vectors: one counts (documents, terms, documents of each asked term), one searches.
The driver holds the items of one batch (at most ``ITEMS`` items or ``ITEM_BYTES`` bytes, a longer item alone) and
one count for each of their terms.

Defined cases: a text without terms, or NULL, is no document (it counts nowhere); rows with one doc_id are
documents of their own; rows with a NULL doc_id count in the statistics but take no rank; equal item rows are
asked once, other rows with one item_id are items of their own, a NULL item_id is one too; items without terms
and empty tables give no rows; further columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of
from millrace.session import materialize

BLOCK = 32
FEW = 4  # documents of a list up to which each is a block of its own
SHARD_ROWS = 4_096
SHARD_CELLS = 1 << 23  # sum of squared vector lengths, which bounds a shard's summaries
SKETCH = 32
SAMPLE = 4_096
ITEMS = 4_096
ITEM_BYTES = 1 << 24

_SPLIT = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of characters that are letters, digits or beyond ASCII; only A-Z become lower case."""
    return text.translate(_SPLIT).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the asked terms with their occurrences, of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, found = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    held = Counter(map(number.get, words))
                    held.pop(None, None)
                    found.append(held)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([list(h) for h in found], pa.list_(pa.int32())),
                     pa.array([list(h.values()) for h in found], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, times array<int>").where("n > 0")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class PostingList:
    """Documents of one term in blocks, and each block's largest weight of that term and of more common ones."""

    def __init__(self, docs: np.ndarray, ends: np.ndarray, columns: np.ndarray, largest: np.ndarray, heads: np.ndarray):
        self.docs, self.ends, self.columns, self.largest, self.heads = docs, ends, columns, largest, heads


class Shard:
    """Vectors of some documents by row and by term, with posting lists that are built when first asked for."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, columns: np.ndarray, weights: np.ndarray, width: int):
        rows = np.repeat(np.arange(len(ids)), lengths)
        order = np.lexsort((columns, rows))
        self.ids, self.lengths, self.width = ids, lengths, width
        self.starts = np.cumsum(lengths) - lengths
        self.columns, self.weights = columns[order], weights[order]
        by_term = np.argsort(self.columns, kind="stable")
        self.posted = rows[by_term]
        self.edges = np.searchsorted(self.columns[by_term], np.arange(width + 1))
        self.largest = np.zeros(width, np.int64)
        held = np.flatnonzero(np.diff(self.edges))
        if len(held):
            self.largest[held] = np.maximum.reduceat(self.weights[by_term], self.edges[held])
        self.lists: dict[int, PostingList] = {}
        self._sketch: np.ndarray | None = None

    def sketch(self) -> np.ndarray:
        if self._sketch is None:
            signs = np.random.default_rng(42).choice(np.array([-1.0, 1.0], np.float32), (self.width, SKETCH))
            self._sketch = np.zeros((len(self.ids), SKETCH), np.float32)
            some = np.flatnonzero(self.lengths)
            if len(some):
                cells = signs[self.columns] * self.weights[:, None].astype(np.float32)
                self._sketch[some] = np.add.reduceat(cells, self.starts[some], axis=0)
                norms = np.sqrt((self._sketch ** 2).sum(axis=1, keepdims=True))
                self._sketch /= np.where(norms > 0, norms, 1)
        return self._sketch

    def posting_list(self, term: int) -> PostingList:
        known = self.lists.get(term)
        if known is None:
            known = self.lists[term] = self._build(term)
        return known

    def _build(self, term: int) -> PostingList:
        docs = self.posted[self.edges[term]: self.edges[term + 1]]
        count = -(-len(docs) // BLOCK)
        block = np.zeros(len(docs), np.int64)
        if count > 1:
            near = self.sketch()[docs]
            block = np.argmax(near @ near[np.arange(count) * len(docs) // count].T, axis=1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            block = np.cumsum(np.diff(block, prepend=block[0]) > 0)
        lengths = self.lengths[docs]
        cells = _ranges(self.starts[docs], lengths)
        columns, owner = self.columns[cells], np.repeat(block, lengths)
        counted = columns >= term
        key, weights = owner[counted] * self.width + columns[counted], self.weights[cells[counted]]
        order = np.argsort(key, kind="stable")
        key, weights = key[order], weights[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        largest, key = np.maximum.reduceat(weights, first), key[first]
        blocks = int(block[-1]) + 1
        heads = np.searchsorted(key, np.arange(blocks) * self.width)
        return PostingList(docs, np.searchsorted(block, np.arange(blocks), side="right"), key % self.width, largest, heads)

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold at least one term."""
        lengths = self.lengths[docs]
        cells = _ranges(self.starts[docs], lengths)
        return np.add.reduceat(asked[self.columns[cells]] * self.weights[cells], np.cumsum(lengths) - lengths)


class Best:
    """The k best (score, doc_id) of one item so far, and the score that a further document must reach."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def search_shard(shard: Shard, places: np.ndarray, times: np.ndarray, best: Best, asked: np.ndarray) -> None:
    """Offer a shard's documents to ``best``; ``places`` are the item's terms from rare to common, ``asked`` is scratch of zeros."""
    reach = np.cumsum((times * shard.largest[places])[::-1])[::-1]
    if not len(places) or reach[0] < best.floor:
        return
    asked[places] = times
    seen = np.zeros(len(shard.ids), bool)
    for place, most in zip(places.tolist(), reach.tolist()):
        if most < best.floor:
            break
        a, b = shard.edges[place], shard.edges[place + 1]
        if a == b:
            continue
        if b - a <= FEW:
            listed = docs = shard.posted[a:b]
        else:
            blocks = shard.posting_list(place)
            bounds = np.add.reduceat(asked[blocks.columns] * blocks.largest, blocks.heads)
            good = np.flatnonzero(bounds >= best.floor)
            starts = np.concatenate([[0], blocks.ends[:-1]])[good]
            listed, docs = blocks.docs, blocks.docs[_ranges(starts, blocks.ends[good] - starts)]
        docs = docs[~seen[docs]]
        if len(docs):
            best.add(shard.scores(docs, asked), shard.ids[docs])
        seen[listed] = True
    asked[places] = 0


def _shards(batch: pa.RecordBatch, place: np.ndarray, weight: np.ndarray, per_length: tuple[int, int]) -> Iterator[Shard]:
    documents, total = per_length
    for row in range(0, batch.num_rows, SHARD_ROWS):
        part = batch.slice(row, SHARD_ROWS)
        ids, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
        lists = part.column("terms")
        lengths = np.diff(lists.offsets.to_numpy())
        columns = place[lists.flatten().to_numpy()]
        times = part.column("times").flatten().to_numpy().astype(np.int64)
        m = np.repeat(75 + 25 * n * documents // total, lengths)
        weights = weight[columns] * (1_000_000_000 * times // (1000 * times + 12 * m))
        cells = np.cumsum(lengths.astype(np.int64) ** 2)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ids):
            used = cells[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cells, used + SHARD_CELLS, side="right")))
            a, b = (ends[start - 1] if start else 0), ends[stop - 1]
            yield Shard(ids[start:stop], lengths[start:stop], columns[a:b], weights[a:b], len(place))
            start = stop


def _search(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], floors: list[int], place: np.ndarray,
            weight: np.ndarray, per_length: tuple[int, int], k: int) -> DataFrame:
    """item (number), doc_id, score of the k best documents of every item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, floor) for floor in floors]
        asked = np.zeros(len(place), np.int64)
        for batch in batches:
            for shard in _shards(batch, place, weight, per_length):
                for (places, times), own in zip(items, best):
                    search_shard(shard, places, times, own, asked)
        numbers = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers.astype(np.int32)), pa.array(np.concatenate([b.ids for b in best])),
             pa.array(np.concatenate([b.scores for b in best]))], names=["item", "doc_id", "score"])

    return vectors.where("doc_id IS NOT NULL").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """Results of one batch of items; None if no document can match."""
    spark = docs.sparkSession
    counts = [Counter(terms((r.text or "").encode())) for r in rows]
    number = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    if not number:
        return None
    vectors = materialize(_vectors(docs, number))
    documents, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return None
    holding = np.zeros(len(number), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row.term] = row["count"]
    order = np.lexsort((np.arange(len(number)), holding))  # rare terms first
    place = np.empty(len(number), np.int64)
    place[order] = np.arange(len(number))
    weight = np.array([term_weight(documents, h) for h in holding[order].tolist()], np.int64)
    items = []
    for count in counts:
        places = place[[number[t] for t in count]] if count else np.zeros(0, np.int64)
        by_place = np.argsort(places)
        items.append((places[by_place], np.array(list(count.values()), np.int64)[by_place]))
    shared = (place, weight, (documents, total), k)
    share = min(1 << 20, -(-(SAMPLE << 20) // documents))  # about SAMPLE documents, chosen where they are
    sample = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    floors = [1] * len(items)
    for row in _ranked(_search(sample, items, floors, *shared), k).where(F.col("rank") == k).collect():
        floors[row.item] = row.score
    found = _ranked(_search(vectors, items, floors, *shared), k)
    kind = docs.sparkSession.createDataFrame(
        [(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {rows[0].kind}")
    return found.join(F.broadcast(kind), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) for every item (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", text_of().alias("text"), F.lit(kind).alias("kind")).distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    batches = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    results = []
    for number in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == number).collect()
        results.append(_batch(docs, rows, k) if rows else None)
    results = [r for r in results if r is not None]
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
