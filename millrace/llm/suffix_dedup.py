"""Removal of repeated byte strings with a distributed sparse suffix array.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a document with a smaller id. Not
every suffix is sorted: in each window the ``GRAM``-byte string with the least hash is its anchor, so equal
windows have equal anchors at equal places, and only suffixes at anchors (about one in seventeen) are kept,
each with the bytes its windows reach to the left and right. The result is that of the full suffix array.

1. Documents go to blocks of a few megabytes by a hash of their id. Every block sends the distinct hashes of
   its anchor grams and hears which of them occur in another block as well; the others can match nothing.
2. The suffixes that are left are range-partitioned by their leading bytes with splitters from a sample.
   Copies inside a block are settled before that, so a passage that many documents share sends one suffix a
   block. Splitters cut between different leading bytes and every match has ``GRAM`` leading bytes in
   common, so all partners of a suffix are in its bucket and nothing matches across a boundary.
3. A bucket sorts its suffixes by multikey sorting on eight-byte words. Equal records settle whole; in groups
   with a common gram and several documents every window is compared, byte by byte through the same sort.
4. Covered ranges return to the blocks, which cut the texts.

Blocks and buckets have a bounded size; the texts are shuffled once and read from that shuffle three times.

Defined cases: NULL counts as the empty text; rows with equal ids never remove from one another; rows with
a NULL id lose nothing and remove nothing; texts under ``WINDOW`` bytes stay; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of

WINDOW = 50
GRAM = 16
LEFT = WINDOW - GRAM  # most bytes of a window before its anchor
RECORD = 88  # right context, left context backwards, both reaches, padding
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 64
SAMPLE_DOCS = 1_000
SAMPLE_KEYS = 20_000
FILTER_BITS = 40
WITHIN = 4 << 20

_FACTOR = 0x9E3779B97F4A7C15
_U64 = np.uint64


class Anchors(NamedTuple):
    """Anchors of a piece of text: place, first and last window start, hash of the gram."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U64(32))


def find_anchors(data: np.ndarray, ends: np.ndarray) -> Anchors:
    """Anchors of the concatenated documents that end at ``ends``; no window crosses a document."""
    none = np.zeros(0, np.int64)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return Anchors(none, none, none, none.astype(_U64))
    h, length = data.astype(_U64) + _U64(1), 1
    while length < GRAM:
        h = h[:-length] * _U64(pow(_FACTOR, length, 1 << 64)) + h[length:]
        length *= 2
    h = _mixed(h)
    # low half: the place, so that the least value is the leftmost of equal hashes
    least = (h & _U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U64)
    span, width = 1, WINDOW - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    place = (least & _U64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int32)
    whole = ends - starts >= WINDOW
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    if not len(windows):
        return Anchors(none, none, none, none.astype(_U64))
    own = place[windows]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([new[1:], [len(windows)]]) - 1
    at = own[new]
    return Anchors(at, windows[new], windows[last], h[at])


def records_of(data: np.ndarray, anchors: Anchors) -> np.ndarray:
    """One row of bytes per anchor: its suffix, its left side backwards, both reaches."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[anchors.at]
    out = np.zeros((len(anchors.at), RECORD), np.uint8)
    before, after = anchors.at - anchors.first, anchors.last + WINDOW - anchors.at
    out[:, :WINDOW] = around[:, LEFT:] * (np.arange(WINDOW) < after[:, None])
    out[:, WINDOW: WINDOW + LEFT] = around[:, :LEFT][:, ::-1] * (np.arange(LEFT) < before[:, None])
    out[:, WINDOW + LEFT] = before
    out[:, WINDOW + LEFT + 1] = WINDOW - after
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Eight-byte words that compare as the bytes do."""
    return np.ascontiguousarray(rows).view(">u8").astype(_U64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many leading words each has in common with the row before it.

    Rows are sorted by their first word; from then on only runs that are still equal are sorted, by the
    next word.
    """
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    common = np.zeros(n, np.int64)
    if n < 2:
        return order, common
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    common[tied] = 1
    for column in range(1, width):
        member = tied | np.concatenate([tied[1:], [False]])
        rows = np.flatnonzero(member)
        if not len(rows):
            break
        run = np.cumsum(~tied)[rows]
        part = order[rows]
        part = part[np.lexsort((words[part, column], run))]
        order[rows] = part
        value = words[part, column]
        same = np.concatenate([[False], value[1:] == value[:-1]]) & tied[rows]
        tied = np.zeros(n, bool)
        tied[rows[same]] = True
        common[tied] = column + 1
    return order, common


def _later(docs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a row's document is not the first of its run; runs begin where ``begins`` is true."""
    starts = np.flatnonzero(begins)
    first = np.minimum.reduceat(docs, starts)
    return docs > first[np.cumsum(begins) - 1]


class Found(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def match_records(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Rows whose every window is in an earlier document; and (rows, bytes before the anchor) of single windows."""
    order, common = multikey_sort(_words(rows))
    rows, docs = rows[order], docs[order]
    settled = _later(docs, common < RECORD // 8)
    whole = order[settled]
    rows, docs, order = rows[~settled], docs[~settled], order[~settled]
    leads = _words(rows[:, :GRAM])
    begins = np.concatenate([[True], (leads[1:] != leads[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    if not len(rows):
        return whole, []
    run = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    keep = several[run]
    rows, docs, order = rows[keep], docs[keep], order[keep]
    single = []
    before, behind = rows[:, WINDOW + LEFT], rows[:, WINDOW + LEFT + 1]
    for reach in range(LEFT + 1):
        own = np.flatnonzero((behind <= reach) & (reach <= before))
        if len(own) < 2:
            continue
        window = np.zeros((len(own), 56), np.uint8)
        window[:, : WINDOW - reach] = rows[own, : WINDOW - reach]
        window[:, WINDOW - reach: WINDOW] = rows[own, WINDOW: WINDOW + reach]
        by, common = multikey_sort(_words(window))
        later = _later(docs[own[by]], common < 7)
        if later.any():
            single.append((order[own[by[later]]], reach))
    return whole, single


# -- blobs: arrays that travel as one compressed value, planes of bytes together --------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T if len(raw) else raw.view(np.uint8)
        parts.append(np.ascontiguousarray(planes).tobytes())
    head = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpacked(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(kinds)}Q", data)
    out, at = [], 8 * len(kinds)
    for (kind, columns), size in zip(kinds, sizes):
        item = np.dtype(kind).itemsize * columns
        planes = np.frombuffer(data, np.uint8, size, at).reshape(item, -1)
        rows = np.ascontiguousarray(planes.T).view(kind)
        out.append(rows if columns > 1 else rows.reshape(-1))
        at += size
    return out


class Block(NamedTuple):
    """Rows of a block in a fixed order."""

    ids: np.ndarray
    known: np.ndarray  # whether the id is not NULL
    texts: list[bytes]

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, bytes, ends of the documents) of consecutive rows of about ``WITHIN`` bytes."""
        start = 0
        while start < len(self.texts):
            stop, held = start, 0
            while stop < len(self.texts) and (stop == start or held + len(self.texts[stop]) <= WITHIN):
                held += len(self.texts[stop])
                stop += 1
            ends = np.cumsum([len(t) if k else 0 for t, k in zip(self.texts[start:stop], self.known[start:stop])])
            joined = b"".join(t for t, k in zip(self.texts[start:stop], self.known[start:stop]) if k)
            yield start, np.frombuffer(joined, np.uint8), ends.astype(np.int64)
            start = stop


def _block(table: pa.Table) -> Block:
    ids = table.column("doc_id").to_pylist()
    texts = table.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return Block(np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is not None for i in order], bool),
                 [texts[i] for i in order])


def _filter_hash(gram: np.ndarray) -> np.ndarray:
    return _mixed(gram * _U64(_FACTOR)) >> _U64(64 - FILTER_BITS)


def _distinct_grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct filter hashes of a block, and which of them occur in several of its documents."""
    hashes, owners = [], []
    for first, data, ends in block.pieces():
        anchors = find_anchors(data, ends)
        hashes.append(_filter_hash(anchors.gram))
        owners.append(block.ids[first + np.searchsorted(ends, anchors.at, side="right")])
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, np.zeros(0, bool)
    return h[starts], np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the hash ranges of all buckets in a sorted array."""
    marks = np.array([(b << FILTER_BITS) // buckets for b in range(1, buckets)], _U64)
    return np.concatenate([[0], np.searchsorted(hashes, marks), [len(hashes)]])


def _rows(names: list[str], columns: list[list]) -> pa.Table:
    kinds = {"block": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
    return pa.table([pa.array(c, kinds[n]) for n, c in zip(names, columns)], names=names)


def _splitters(rows: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Leading words that part a sample of the suffixes into equal ranges; only the balance depends on it."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                anchors = find_anchors(data, np.cumsum([len(t) for t in texts], dtype=np.int64))
                some = Anchors(*[a[::4] for a in anchors])
                keys = _words(records_of(data, some)[:, :8]).reshape(-1) if len(some.at) else np.zeros(0, _U64)
                yield pa.RecordBatch.from_arrays([pa.array((keys ^ _U64(1 << 63)).view(np.int64))], names=["lead"])

    few = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    sample = few.select("text").mapInArrow(leads, "lead long").orderBy(F.xxhash64("lead")).limit(SAMPLE_KEYS).toArrow()
    keys = np.sort(sample.column("lead").to_numpy().astype(np.int64).view(_U64) ^ _U64(1 << 63))
    if not len(keys):
        return np.zeros(0, _U64)
    return np.unique(keys[np.linspace(0, len(keys), buckets, endpoint=False).astype(int)[1:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    splitters = _splitters(rows, n, blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        hashes, _ = _distinct_grams(_block(table))
        cuts = _cuts(hashes, blocks)
        own = [b for b in range(blocks) if cuts[b + 1] > cuts[b]]
        blobs = [_packed(np.diff(hashes[cuts[b]: cuts[b + 1]], prepend=_U64(0))) for b in own]
        return _rows(["bucket", "block", "blob"], [own, [number] * len(own), blobs])

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        sent = [np.cumsum(_unpacked(b, ("<u8", 1))[0], dtype=_U64) for b in table.column("blob").to_pylist()]
        joined = np.sort(np.concatenate(sent))
        shared = np.unique(joined[1:][joined[1:] == joined[:-1]])
        blobs = []
        for hashes in sent:
            hit = np.searchsorted(shared, hashes)
            known = shared[np.minimum(hit, len(shared) - 1)] == hashes if len(shared) else np.zeros(len(hashes), bool)
            blobs.append(np.packbits(known).tobytes())
        return _rows(["block", "bucket", "blob"], [table.column("block").to_pylist(), [bucket] * len(sent), blobs])

    def suffixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(["bucket", "block", "blob"], [[], [], []])
        number = table.column("block")[0].as_py()
        block = _block(table)
        hashes, wanted = _distinct_grams(block)
        cuts = _cuts(hashes, blocks)
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()):
            low, high = cuts[bucket], cuts[bucket + 1]
            wanted[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        shared = hashes[wanted]
        parts = []
        for first, data, ends in block.pieces():
            anchors = find_anchors(data, ends)
            if len(anchors.at) and len(shared):
                own = _filter_hash(anchors.gram)
                keep = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
                anchors = Anchors(*[a[keep] for a in anchors])
                row = np.searchsorted(ends, anchors.at, side="right")
                start = np.concatenate([[0], ends[:-1]])[row]
                parts.append((records_of(data, anchors), first + row, anchors.at - start))
        if not parts:
            return _rows(["bucket", "block", "blob"], [[], [], []])
        records, row, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        docs_of = block.ids[row]
        # copies within the block: only those in the first document go on, the rest is settled here
        order, common = multikey_sort(_words(records))
        records, row, at, docs_of = records[order], row[order], at[order], docs_of[order]
        settled = _later(docs_of, common < RECORD // 8)
        start = at[settled] - records[settled, WINDOW + LEFT]
        end = at[settled] - records[settled, WINDOW + LEFT + 1] + WINDOW
        buckets, owners, blobs = [-1], [number], [_packed(row[settled].astype("<u4"), start.astype("<u4"), end.astype("<u4"))]
        records, row, at, docs_of = records[~settled], row[~settled], at[~settled], docs_of[~settled]
        bounds = np.concatenate([[0], np.searchsorted(_words(records[:, :8]).reshape(-1), splitters), [len(records)]])
        for bucket, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            if high > low:
                buckets.append(bucket)
                owners.append(number)
                blobs.append(_packed(records[low:high], docs_of[low:high].astype("<i8"), row[low:high].astype("<u4"),
                                     at[low:high].astype("<u4")))
        return _rows(["bucket", "block", "blob"], [buckets, owners, blobs])

    def compare(table: pa.Table) -> pa.Table:
        owners = table.column("block").to_pylist()
        kinds = (("u1", RECORD), ("<i8", 1), ("<u4", 1), ("<u4", 1))
        sent = [_unpacked(b, *kinds) for b in table.column("blob").to_pylist()]
        records, docs_of, row, at = (np.concatenate([s[i] for s in sent]) for i in range(4))
        owner = np.repeat(np.arange(len(sent)), [len(s[1]) for s in sent])
        at = at.astype(np.int64)
        whole, single = match_records(records, docs_of)
        who = [whole]
        start = [at[whole] - records[whole, WINDOW + LEFT]]
        end = [at[whole] - records[whole, WINDOW + LEFT + 1] + WINDOW]
        for hit, reach in single:
            who.append(hit)
            start.append(at[hit] - reach)
            end.append(at[hit] - reach + WINDOW)
        who, start, end = np.concatenate(who), np.concatenate(start), np.concatenate(end)
        by = np.argsort(owner[who], kind="stable")
        who, start, end = who[by], start[by], end[by]
        bounds = np.searchsorted(owner[who], np.arange(len(sent) + 1))
        names, blobs = [], []
        for number, low, high in zip(owners, bounds[:-1], bounds[1:]):
            if high > low:
                names.append(number)
                blobs.append(_packed(row[who[low:high]].astype("<u4"), start[low:high].astype("<u4"), end[low:high].astype("<u4")))
        return _rows(["block", "blob"], [names, blobs])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        block = _block(table) if table.num_rows else Block(np.zeros(0, np.int64), np.zeros(0, bool), [])
        sizes = np.array([len(t) for t in block.texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cover = np.zeros(starts[-1] + 1, np.int32)
        for blob in found.column("blob").to_pylist():
            row, start, end = (a.astype(np.int64) for a in _unpacked(blob, *[("<u4", 1)] * 3))
            np.add.at(cover, starts[row] + start, 1)
            np.add.at(cover, starts[row] + end, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed, spans, digests = [], [], []
        for i, text in enumerate(block.texts):
            own = gone[starts[i]: starts[i + 1]]
            removed.append(int(own.sum()))
            spans.append(int((own & ~np.concatenate([[False], own[:-1]])).sum()))
            kept = np.frombuffer(text, np.uint8)[~own].tobytes() if removed[-1] else text
            digests.append(hashlib.sha256(kept).hexdigest())
        ids = pa.array(np.where(block.known, block.ids, 0), pa.int64(), mask=~block.known)
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                         pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, blob binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, blob binary")
    sent = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        suffixes, "bucket int, block int, blob binary")
    # bucket -1 holds what a block could settle alone and returns as it is; a block of its own keeps it apart
    matched = sent.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("block")).alias("alone")).applyInArrow(
        lambda table: table.select(["block", "blob"]) if table.column("bucket")[0].as_py() < 0 else compare(table),
        "block int, blob binary")
    return dealt.groupBy("block").cogroup(matched.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
