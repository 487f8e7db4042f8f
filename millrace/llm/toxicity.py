"""Toxicity by a fuzzy lexicon in context.

The lexicon (words and word beginnings that speak for a toxic label) is learned from labelled rows. It
stands in a trie; a Levenshtein automaton for one edit is run against the trie for all distinct words
of a piece of text at once: each trie node holds the automaton states of the words still alive there, and
words whose every state exceeds the limit leave. Each hit is weighed by its log-odds, by how often its
spelling occurs in clean rows, and by the words around it: quotation marks and reporting words speak
for a quotation, words of address for abuse. A logistic model over a few document features scores.

The labelled rows used for the fit are bounded by ``rows`` (those with the smallest hashes of the id), which
also bounds the inexact spellings that the model keeps, all of those in these rows. The lexicon holds the
``MOST_TERMS`` terms with the most toxic rows of their own; a rarer term counts only where a listed word or
beginning also matches it. Scoring reads every row. Labels of rows held out by ``training`` are never read.

Defined cases: NULL counts as the empty text, which scores like any text without hits; without labelled
rows of both kinds every score is 0; several labels of one id count as toxic if one is; equal rows get equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of
from millrace.session import materialize

FIT_ROWS = 20_000
MOST_TERMS = 512
PREFIXES = (4, 5, 6, 7)
FUZZY_FROM = 5
LEAST_PRECISION = 0.8
LEAST_SUPPORT = 4
FLUSH = 200_000
WINDOW = 5
FEATURES = 7
STRONG = 3.0  # log-odds from which an exact hit, or two disguised ones, count as evidence of their own

# fixed values: marks and words that speak for a quotation or for address
MARKS = "\"'“”„«»‘’‹›`*_~.,;:!?()[]{}<>|#$%&+=-/\\…"
QUOTES = set("\"“”„«»‹›")
REPORTING = {"said", "says", "called", "wrote", "quote", "quoted", "word", "term", "sagte", "schrieb", "dijo", "dit"}
ADDRESS = {"you", "your", "you're", "youre", "u", "ur", "du", "dich", "dein", "tu", "te", "vous", "eres", "usted"}


def training(share: int = 5, left: int = 0) -> Column:
    """Rows whose labels may be learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(share)) != left


class Words(NamedTuple):
    """Words of a piece: per word its place in ``spellings``; per document where its words begin."""

    places: np.ndarray
    offsets: np.ndarray
    raw: list[str]
    spellings: list[str]


def words_of(texts: pa.Array) -> Words:
    """Lower-cased words between white space; spellings are stripped of marks at both ends."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    offsets = np.asarray(lists.offsets)
    coded = lists.flatten().dictionary_encode()
    raw = coded.dictionary.to_pylist()
    return Words(np.asarray(coded.indices), offsets - offsets[0], raw, [w.strip(MARKS) for w in raw])


class Trie:
    """Terms by letter; ``match`` intersects them with the one-edit automata of many words."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.root: dict = {}
        self.width = 2 + max((len(t) for t, _ in terms), default=0)
        for number, (term, _) in enumerate(terms):
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node.setdefault("", []).append(number)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best term (-1: none) and edits of every word; fewer edits first, then the earlier term."""
        best, edits = np.full(len(words), -1), np.full(len(words), 2)
        if not words or not self.terms:
            return best, edits
        letters = np.array(words, dtype=f"<U{self.width}").view(np.uint32).reshape(len(words), self.width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        alive = np.arange(len(words))
        # states: edits after reading depth-1, depth and depth+1 letters of the word; 2 means too many
        start = np.tile(np.array([2, 0, 1], np.int8), (len(words), 1))
        start[sizes < 1, 2] = 2
        self._walk(self.root, 0, alive, start, letters, sizes, best, edits)
        return best, edits

    def _walk(self, node, depth, alive, states, letters, sizes, best, edits):
        for number in node.get("", ()):
            _, prefix = self.terms[number]
            reach = sizes[alive] - depth + 1
            if prefix:
                cost = states.min(axis=1)
            else:
                inside = (reach >= 0) & (reach <= 2)
                cost = np.where(inside, states[np.arange(len(alive)), np.clip(reach, 0, 2)], 2)
            limit = 1 if depth >= FUZZY_FROM and not prefix else 0
            ahead = (cost < edits[alive]) | ((cost == edits[alive]) & (number < best[alive]))
            better = (cost <= limit) & ahead
            best[alive[better]] = number
            edits[alive[better]] = cost[better]
        for letter, child in node.items():
            if letter == "":
                continue
            code, fresh = ord(letter), np.full_like(states, 2)
            for k in range(3):
                at = depth + k - 1  # letter of the word that this state reads
                if at >= 0 and at < self.width:
                    hit = letters[alive, at] == code
                    fresh[:, k] = states[:, k] + np.where(hit, 0, 1)
                    fresh[sizes[alive] <= at, k] = 2
                if k < 2:
                    np.minimum(fresh[:, k], states[:, k + 1] + 1, out=fresh[:, k])
                if k and at >= 0:
                    longer = np.where(sizes[alive] > at, fresh[:, k - 1] + 1, 2)
                    np.minimum(fresh[:, k], longer, out=fresh[:, k], casting="unsafe")
            lives = fresh.min(axis=1) <= 1
            if lives.any():
                self._walk(child, depth + 1, alive[lives], fresh[lives], letters, sizes, best, edits)


class Model(NamedTuple):
    terms: list[tuple[str, bool]]
    weights: list[float]
    spellings: dict[str, float]
    coefficients: list[float]


def _near(words: Words, at: int, low: int, high: int) -> tuple[bool, bool]:
    """Whether the words around a hit speak for a quotation and for address."""
    around = range(max(low, at - WINDOW), min(high, at + WINDOW + 1))
    own = words.raw[words.places[at]]
    texts = [words.raw[words.places[i]] for i in around]
    here = at - around[0]
    opened = any(t[:1] in QUOTES for t in texts[: here + 1])
    closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in texts[here:])
    spoken = any(words.spellings[words.places[i]] in REPORTING for i in around)
    addressed = any(words.spellings[words.places[i]] in ADDRESS for i in around) or own.endswith("!")
    return (opened and closed) or spoken, addressed


def features(texts: pa.Array, model: Model, trie: Trie) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """A row of document features each, and the inexact hits as (document, spelling)."""
    words = words_of(texts)
    best, edits = trie.match(words.spellings)
    found = np.nonzero(best[words.places] >= 0)[0] if len(words.places) else np.array([], int)
    owner = np.searchsorted(words.offsets, found, side="right") - 1
    out = np.zeros((len(texts), FEATURES))
    out[:, 0] = 1
    inexact = []
    for at, doc in zip(found.tolist(), owner.tolist()):
        place = words.places[at]
        term, edit, spelling = best[place], edits[place], words.spellings[place]
        weight = model.weights[term]
        strong = weight >= STRONG
        if edit:
            inexact.append((doc, spelling))
            # a spelling that no labelled row has is a likely disguise, but one alone may be chance
            strong = strong and spelling not in model.spellings
            weight = model.spellings.get(spelling, 0.5 * weight)
        if weight <= 0:
            continue
        quoted, addressed = _near(words, at, words.offsets[doc], words.offsets[doc + 1])
        if quoted and not addressed:
            weight, strong = 0.3 * weight, False
        row = out[doc]
        row[1] = max(row[1], weight)
        row[2] += weight
        row[3 if edit else 4] += 1
        row[5] += 1 if addressed else 0
        if strong:
            row[6] += 0.5 if edit else 1
    out[:, 6] = out[:, 6] >= 1
    out[:, 2:6] = np.log1p(out[:, 2:6])
    return out, inexact


def _odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, prefix, toxic, clean): in how many rows each word and word beginning occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[int]] = {}

        def flushed() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                       *[pa.array([held[k][i] for k in keys], pa.int64()) for i in (1, 0)]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "prefix", "toxic", "clean"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                for row, label in enumerate(part.column("toxic").to_pylist()):
                    own = {words.spellings[p] for p in words.places[words.offsets[row]: words.offsets[row + 1]].tolist()}
                    terms = {(w, False) for w in own if 3 <= len(w) <= 24}
                    terms |= {(w[:n], True) for w in own for n in PREFIXES if len(w) > n}
                    for term in terms:
                        held.setdefault(term, [0, 0])[label] += 1
                    if len(held) > FLUSH:
                        yield flushed()
        yield flushed()

    counted = sample.select("text", "toxic").mapInArrow(count, "term string, prefix boolean, toxic long, clean long")
    return counted.groupBy("term", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _without_echoes(terms: list) -> list:
    """Terms without the word beginnings whose rows are nearly all due to one listed word."""
    most: dict[str, int] = {}
    for t in terms:
        if not t.prefix:
            for n in PREFIXES:
                most[t.term[:n]] = max(most.get(t.term[:n], 0), t.toxic)
    return [t for t in terms if not t.prefix or most.get(t.term, 0) < 0.9 * t.toxic]


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> list[float]:
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.01] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge, x.T @ (times * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled rows (labels: doc_id, toxic)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = materialize(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    all_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if all_toxic in (0, n):
        return Model([], [], {}, [])
    precise = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= LEAST_PRECISION
    # of beginnings and words that select the same rows the longest beginning says most
    terms = _term_counts(sample).where(precise & (F.col("toxic") >= LEAST_SUPPORT)).orderBy(
        F.desc(F.col("toxic") - 4 * F.col("clean")), "prefix", F.desc(F.length("term")), "term").limit(2 * MOST_TERMS).collect()
    terms = _without_echoes(terms)[:MOST_TERMS]
    model = Model([(t.term, t.prefix) for t in terms],
                  [_odds(t.toxic, t.clean, all_toxic, n - all_toxic) for t in terms], {}, [0.0] * FEATURES)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms)
        for batch in batches:
            for part in slices(batch, "text"):
                hits = set(features(part.column("text"), model, trie)[1])
                toxic = part.column("toxic").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for _, s in hits], pa.string()), pa.array([toxic[d] for d, _ in hits], pa.int64())],
                    names=["spelling", "toxic"])

    forms = sample.mapInArrow(spell, "spelling string, toxic long").groupBy("spelling").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()
    model = model._replace(spellings={
        f.spelling: _odds(f.toxic, f.n - f.toxic, all_toxic, n - all_toxic) for f in forms})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms)
        for batch in batches:
            for part in slices(batch, "text"):
                table = features(part.column("text"), model, trie)[0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), *[pa.array(table[:, i]) for i in range(FEATURES)]],
                    names=["toxic", *[f"f{i}" for i in range(FEATURES)]])

    schema = "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))
    # equal feature rows are merged before they travel: most rows have no hit at all
    rows_seen = sample.mapInArrow(describe, schema).groupBy("toxic", *[f"f{i}" for i in range(FEATURES)]).count().toArrow()
    y = rows_seen.column("toxic").to_numpy().astype(float)
    x = np.column_stack([rows_seen.column(f"f{i}").to_numpy() for i in range(FEATURES)])
    times = rows_seen.column("count").to_numpy()
    return model._replace(coefficients=_logistic(x, y, times.astype(float)))


def _scores(texts: pa.Array, model: Model, trie: Trie) -> np.ndarray:
    if not model.coefficients:
        return np.zeros(len(texts))
    table = features(texts, model, trie)[0]
    return 1 / (1 + np.exp(-np.clip(table @ np.array(model.coefficients), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms)
        for batch in batches:
            for part in slices(batch, "text"):
                values = pa.array(_scores(part.column("text"), model, trie), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model.terms)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                yield part.filter(pa.array(_scores(texts, model, trie) < threshold))

    return docs.mapInArrow(run, docs.schema)
