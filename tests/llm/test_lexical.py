"""Ranked lexical search against a plain computation."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical
from tests.llm.helpers import AWKWARD, table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=20):
    held = [(d, words(t)) for d, t in docs]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    documents, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        ranked = []
        for doc, count, n in held:
            m = 100 - 25 + (25 * n * documents) // total
            score = sum(times * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * count[t]) // (1000 * count[t] + 12 * m))
                        for t, times in Counter(words(text)).items() if t in count)
            if score > 0 and doc is not None:
                ranked.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.ranked_search(d, i, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, count):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Größe", "naïve", "日本", "X9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(pick.choices(vocabulary, weights, k=pick.randint(0, 60))) for _ in range(count)]
    for i in range(0, count, 7):
        texts[i] = texts[0].replace("w1", "W1", i % 3)  # copies and near copies
    return texts


@pytest.mark.parametrize("sizes", [(32, 4, 4096, 4096), (2, 1, 50, 1), (3, 0, 4096, 64)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "FEW", "SHARD_ROWS", "SAMPLE"), sizes):
        monkeypatch.setattr(lexical, name, value)
    texts = corpus(1, 300)
    docs = list(enumerate(texts)) + [(7, "w3 w4"), (7, "w3 w4"), (None, "w5 w6"), (900, None), (901, " ,; ")]
    items = [(i, t) for i, t in enumerate(corpus(2, 25))] + [(50, "W7 w7 w7, w99!"), (51, "unseen"), (52, ""), (53, None), (None, "w2")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items[:4], 3) == brute(docs, items[:4], 3)


def test_many_batches(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs, items = list(enumerate(corpus(3, 60))), list(enumerate(corpus(4, 11)))
    assert found(spark, docs, items) == brute(docs, items)


def test_bounds_cover_and_skip():
    pick = np.random.default_rng(8)
    lengths = pick.integers(1, 30, 500)
    columns = np.concatenate([pick.choice(80, n, replace=False) for n in lengths])
    shard = lexical.Shard(np.arange(500), lengths, columns, pick.integers(1, 1000, len(columns)), 80)
    asked = pick.integers(0, 3, 80)
    for term in range(80):
        blocks = shard.posting_list(term)
        assert sorted(blocks.docs.tolist()) == sorted(shard.posted[shard.edges[term]: shard.edges[term + 1]].tolist())
        later = np.where(np.arange(80) >= term, asked, 0)
        bounds = np.add.reduceat(later[blocks.columns] * blocks.largest, blocks.heads)
        start = 0
        for end, bound in zip(blocks.ends, bounds):
            scores = shard.scores(blocks.docs[start:end], later)
            assert scores.max() <= bound
            start = end
    best, scored = lexical.Best(5), []
    full, scores = lexical.Shard.scores, shard.scores(np.arange(500), np.ones(80, np.int64))
    try:
        lexical.Shard.scores = lambda self, docs, q: scored.extend(docs.tolist()) or full(self, docs, q)
        lexical.search_shard(shard, np.arange(80), np.ones(80, np.int64), best, np.zeros(80, np.int64))
    finally:
        lexical.Shard.scores = full
    assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert len(scored) == len(set(scored)) < 500  # no document twice, some never


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    items = spark.createDataFrame([(1, "one two", "en"), (1, "one two", "de"), (2, "word", None)], "item_id long, text string, score string")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, lexical.ranked_search(docs, items).collect()), key=str)
    assert got == brute(plain, [(1, "one two"), (2, "word")])
    for empty in (lexical.ranked_search(docs.limit(0), items), lexical.ranked_search(docs, items.limit(0))):
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
