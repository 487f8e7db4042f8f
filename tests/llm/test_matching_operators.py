"""Top-k, repeats, near copies, contamination, shards, packing and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, packing, shards, simhash, suffix_dedup, topk, toxicity
from millrace.llm.common import read_table
from millrace.llm.graph import components

from ..conftest import DATA
from .helpers import AWKWARD, table, text_of


# -- top-k -----------------------------------------------------------------------------------------------------

def brute_top(rows, k, wanted):
    out = []
    for q in sorted({(i, v) for i, v in rows if wanted(i)}):
        scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in rows if i != q[0])[:k]
        out += [(q[0], rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 1000])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    centers = rng.integers(-spread, spread, (6, 5))
    rows = [(i, tuple(int(x) for x in centers[rng.integers(6)] + rng.integers(-2, 3, 5))) for i in range(700)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, values array<long>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 7).collect()))
    assert got == brute_top(rows, 7, lambda i: i % 50 == 0)


def test_top_k_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -0.0001]),
            (5, [0.5, -0.0001]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (100, [1e10, 1e10]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    vectors = df.select("vec_id", topk.integers(F.col("embedding")).alias("values"))
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()))
    whole = [(i, tuple(int(np.floor(1024 * x)) for x in v) + (0, 0)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, v[:2]) for i, v in whole]
    want = brute_top(whole, 10, lambda i: i % 100 == 0)
    assert got == [(q, r, i, min(max(s, -(2 ** 63)), 2 ** 63 - 1)) for q, r, i, s in want]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# -- repeated byte strings -------------------------------------------------------------------------------------

def brute_repeats(rows):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49 if i is not None else 0):
            window = data[k: k + 50]
            if i < first.setdefault(window, i):
                first[window] = i
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49 if i is not None else 0):
            if first[data[k: k + 50]] < i:
                gone[k: k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(df):
    return sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str)


def test_repeats_equal_brute_force(spark):
    docs = read_table(spark, DATA, "documents")
    assert repeats(docs) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_random_pieces(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(200)) for _ in range(4)]
    rows = []
    for i in range(120):
        text, at = rng.choice(base), rng.randrange(150)
        noise = "".join(rng.choice("abé\n") for _ in range(rng.randrange(60)))
        mixed = text[at: at + rng.randrange(45, 120)] + noise + text[: rng.randrange(40, 70)]
        rows.append((i if i % 17 else None if i % 2 else i - 1, rng.choice([None, "", "a" * rng.randrange(40, 300), mixed]), "s"))
    rows += [(500, "z" * 30_000 + "q", "s"), (501, "z" * 70, "s"), (7, "z" * 60, "s")]
    assert repeats(table(spark, rows)) == brute_repeats([r[:2] for r in rows])


def test_repeats_awkward_rows(spark):
    assert repeats(table(spark, AWKWARD)) == brute_repeats([r[:2] for r in AWKWARD])
    assert suffix_dedup.remove_repeats(table(spark, AWKWARD).limit(0)).count() == 0


def test_multikey_sort_equals_sorted():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, common = suffix_dedup.multikey_sort(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], common[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 4)


# -- near copies -----------------------------------------------------------------------------------------------

def brute_mark(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_roots(marks):
    values = sorted(set(marks))
    array, parent = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 2):
            parent[find(i + 1 + int(j))] = find(i)
    return {v: find(i) for i, v in enumerate(values)}


def check_groups(spark, rows, found):
    marks = {(str(i), t): brute_mark(t) for i, t, _ in rows}
    roots = brute_roots(marks.values())
    least = {}
    for i, t, _ in rows:
        root = roots[marks[str(i), t]]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted((str(i), marks[str(i), t], str(least[roots[marks[str(i), t]]])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found.collect()) == want


def test_simhash_awkward_rows(spark):
    rows = AWKWARD + [(40, "One TWO three", "a"), (41, "one\x0btwo\tthree", "a"), (42, "a b", "a")]
    check_groups(spark, rows, simhash.simhash_groups(table(spark, rows)))
    assert simhash.simhash_groups(table(spark, rows).limit(0)).count() == 0


def test_simhash_on_documents(spark):
    docs = read_table(spark, DATA, "documents")
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    check_groups(spark, rows, simhash.simhash_groups(docs))


@pytest.mark.parametrize("crowded", [2, 24])
def test_links_lose_nothing_in_crowds(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(8)
    marks = {rng.getrandbits(64) for _ in range(150)}
    for center in list(marks)[:3]:
        for _ in range(120):
            mark = center
            for _ in range(rng.randint(1, 4)):
                mark ^= 1 << rng.randrange(64)
            marks.add(mark)
    df = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    found = components(simhash.links(df)).collect()
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    roots = brute_roots(marks)
    groups, want = defaultdict(set), defaultdict(set)
    for m in marks:
        groups[got.get(m, m)].add(m)
        want[roots[m]].add(m)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and len(got) == 501


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b c d e f g", "x"), (9, "other words stand in here now", "x"), (None, "a b c d e f g", "x")]
    kept = simhash.drop_near_copies(table(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"] and kept.columns == table(spark, rows).columns


def test_repeated_ids_keep_one_row_of_a_group(spark):
    text, other, third = "a b c d e f g", "other words stand in here now", "a third text of quite unlike words"
    rows = [(3, text, "x"), (3, text, "x"), (3, "A b  c d e f g", "x"), (4, text, "x"), (5, other, "x"), (5, text, "x"),
            (7, other, "x"), (8, None, "x"), (8, "", "x"), (9, third, "x"), (None, text, "x"), (None, text, "x")]
    kept = [(r.doc_id, " ".join((r.text or "").lower().split())) for r in simhash.drop_near_copies(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(3, text), (5, other), (8, ""), (9, third), (None, text), (None, text)], key=str)


def brute_groups(rows):
    """Least id of the group of every row: marks with two differing bits or less."""
    marks = {key: brute_mark(text) for key, text in rows}
    distinct = sorted(set(marks.values()))
    parent = {m: m for m in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, m in enumerate(distinct):
        for other in distinct[:i]:
            if (m ^ other).bit_count() <= 2:
                parent[find(m)] = find(other)
    least = defaultdict(list)
    for key, mark in marks.items():
        least[find(mark)].append(key)
    return {key: min(least[find(mark)]) for key, mark in marks.items()}


def test_a_crowd_of_unlike_texts_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    shared = rng.choices(vocabulary, k=60)  # a passage that unlike texts share
    texts = [" ".join(rng.choices(vocabulary, k=4) + shared + rng.choices(vocabulary, k=rng.randint(0, 4))) for _ in range(150)]
    texts += [" ".join(shared)] * 40 + ["", None, "  "]
    rng.shuffle(texts)
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(table(spark, rows)).collect()}
    kept = {r.doc_id for r in simhash.drop_near_copies(table(spark, rows)).collect()}
    assert groups == brute_groups([(i, t) for i, t, _ in rows]) and kept == set(groups.values())


def test_near_copies_awkward_rows(spark):
    rows = table(spark, [*AWKWARD, (3, "three words here and more of them", "a")]).withColumn("digest_", F.lit(5)).withColumn(
        "own_digest", F.lit("z"))
    kept = simhash.drop_near_copies(rows).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "4", "5", "7", "8", "9", "None", "None"])
    assert {(r.digest, r.digest_, r.own_digest) for r in kept} == {("x", 5, "z")}
    assert simhash.drop_near_copies(table(spark, AWKWARD).limit(0)).count() == 0


# -- contamination ---------------------------------------------------------------------------------------------

def brute_shingles(text):
    plain = (text or "").lower().translate(str.maketrans(dict.fromkeys(decontaminate.MARKS, " ")))
    words = [w for w in plain.split(" ") if w]
    return {" ".join(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_contained(docs, items):
    sets = [(k, brute_shingles(t)) for k, t in items]
    return sorted({(i, k, round(len(s & brute_shingles(t)) / len(s), 9)) for i, t in docs if i is not None
                   for k, s in sets if s and len(s & brute_shingles(t)) / len(s) >= 0.8})


@pytest.mark.parametrize("limit", ["100000", "1"])
def test_contained_items_equal_brute_force(spark, limit):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 70)))) for k in range(30)] + [(90, None), (91, ""), (92, "..."), (93, "w1 w2")]
    docs = []
    for i in range(80):
        parts = rng.choice(items)[1] or "none"
        parts = parts.split()
        for _ in range(rng.randrange(4)):
            parts[rng.randrange(len(parts))] = "changed"
        around = rng.choices(words, k=rng.randrange(400))
        docs.append((i, " ".join(around + parts + around).upper(), "s"))
    docs += [(200, None, "s"), (None, items[0][1], "s"), (201, items[3][1], "s"), (201, items[3][1], "s"), (202, "w1, w2!", "s")]
    df = table(spark, docs).withColumn("hash", F.lit(1)).withColumn("number", F.lit(1))
    known = spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.millrace.driver.rows", limit)
    try:
        found = decontaminate.contained_items(df, known).collect()
    finally:
        spark.conf.unset("spark.millrace.driver.rows")
    assert sorted((r.doc_id, r.item_id, round(r.containment, 9)) for r in found) == brute_contained([d[:2] for d in docs], items)
    assert decontaminate.contained_items(df.limit(0), known).count() == 0
    assert decontaminate.contained_items(df, known.limit(0)).count() == 0


def test_short_items_are_found_inside_long_documents(spark):
    long = " ".join(f"w{i}" for i in range(300))
    items = spark.createDataFrame([(1, "Zeta!"), (2, "one two"), (3, "p q r s"), (4, ""), (5, None)], "item_id long, text string")
    rows = [(1, f"{long} zeta {long}"), (2, f"{long}, one two. {long}"), (3, f"{long} two one {long}"), (4, f"P, q r s {long}"),
            (5, f"p q r {long} s"), (6, "one"), (7, "p q r"), (8, "zetas"), (9, None), (10, "p q r s"), (None, "zeta")]
    kept = decontaminate.drop_contaminated(table(spark, [(i, t, "a") for i, t in rows]), items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "5", "6", "7", "8", "9", "None"])


# -- shards ----------------------------------------------------------------------------------------------------

def brute_capacity(sizes, shards_wanted):
    capacity = max(sizes)
    while True:
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards_wanted:
            return capacity
        capacity += 1


def test_smallest_capacity():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        for n in (1, 2, 5, 30):
            assert shards.smallest_capacity(sizes, n) == brute_capacity(sizes, n)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_whole_even_and_gapless(spark, monkeypatch, hot):
    monkeypatch.setattr(shards, "FIRST_PREFIX", 1)  # so that ranges are split several times
    rng = random.Random(hot)
    rows = [(i, "t" * rng.randint(0, 400) + str(rng.randrange(250)), "s") for i in range(600)] + AWKWARD[:7]
    rows += [(1000 + i, "the same text", "s") for i in range(500 if hot else 0)]
    got = shards.minimax_shards(table(spark, rows), 6).collect()
    assert len(got) == len(rows)
    by_shard, by_text, groups = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        by_shard[r.shard].append(r)
        by_text[r.content].add(r.shard)
        groups[r.content] += r.size
    assert all(len(s) == 1 for s in by_text.values()) and set(by_shard) <= set(range(6))
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    total, largest = sum(groups.values()), max(groups.values())
    if largest * 6 <= total:
        want = shards.smallest_capacity([groups[c] for c in sorted(groups)], 6)
        assert max(sum(r.size for r in part) for part in by_shard.values()) == want
    else:
        assert max(sum(r.size for r in part) for part in by_shard.values()) == largest


def test_shards_of_nothing(spark):
    assert shards.minimax_shards(table(spark, AWKWARD).limit(0)).count() == 0


# -- packing ---------------------------------------------------------------------------------------------------

def slow_best_fit(sizes, sources, clusters, capacity):
    bins = []
    out = []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= size and not b["s"] & s and not b["c"] & c]
        if fits:
            n = min(fits)[1]
        else:
            bins.append({"room": capacity, "s": 0, "c": 0})
            n = len(bins) - 1
        out.append(n)
        bins[n]["room"] -= size
        bins[n]["s"] |= s
        bins[n]["c"] |= c
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(1, 120)
        sizes = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True)
        sources, clusters = [1 << rng.randrange(4) for _ in range(n)], [rng.choice([0, 1, 2]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 50)[0] == slow_best_fit(sizes, sources, clusters, 50)


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(15)
    bases = [[f"w{rng.randint(0, 3000)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(bases[i % 6])
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None))
    rows += [(200, None, "a"), (201, "", "b"), (202, "  ", "c"), (None, "loose text", "d")]
    docs = packing.with_clusters(table(spark, rows))
    assert docs.count() == len(rows)
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(table(spark, rows)).collect()}
    bins = defaultdict(list)
    got = packing.pack(docs, capacity=4_000, size=F.col("size"), cluster=F.col("near_copies")).collect()
    for r in got:
        bins[r.bin_id].append(groups[r.doc_id])
    assert len(got) == len(rows) and all(len(g) == len(set(g)) for g in bins.values()) and len(set(groups.values())) < 90
    assert packing.pack(packing.with_clusters(table(spark, rows).limit(0)), size=F.col("size"), cluster=F.col("near_copies")).count() == 0


def test_vectors_without_components(spark):
    empty = spark.createDataFrame([(i, []) for i in range(5)], "vec_id long, values array<long>")
    got = sorted(map(tuple, topk.top_k(empty, empty.where("vec_id = 1"), 3).collect()))
    assert got == [(1, 1, 0, 0), (1, 2, 2, 0), (1, 3, 3, 0)]


def test_packing_keeps_its_promises(spark):
    rng = random.Random(7)
    rows = AWKWARD + [(100 + i, "t" * rng.randint(0, 900) + str(i % 40), rng.choice("abcdef")) for i in range(400)]
    got = packing.pack(table(spark, rows), capacity=1000, part_rows=64).collect()
    whole, bins = defaultdict(int), defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.size
        bins[r.bin_id].append(r)
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len(text_of(r).encode())
    assert whole == want
    texts = {r[0]: r for r in rows}
    for part in bins.values():
        spans = sorted((r.bin_offset, r.bin_offset + r.size) for r in part)
        assert spans[-1][1] <= 1000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        sources = [texts[r.doc_id][2] for r in part if texts[r.doc_id][2] is not None]
        assert len(sources) == len(set(sources))
        copies = [text_of(texts[r.doc_id]).lower() for r in part]
        assert len(copies) == len(set(copies))
    assert packing.pack(table(spark, rows).limit(0)).count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = read_table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and set(after) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(docs, read_table(spark, DATA, "labels").where(toxicity.training()))
            bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
            assert set(before) - set(after) == bad
        elif name == "simhash_near_dedup":
            assert set(after) == set(brute_groups([(i, r.text) for i, r in before.items()]).values())
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in read_table(spark, DATA, "benchmark").collect()]
            held = {d[0] for d in brute_contained([(i, r.text) for i, r in before.items()], items)}
            assert set(before) - set(after) == held
        else:
            assert set(before) == set(after)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_awkward_tables(spark, tmp_path):
    docs = table(spark, AWKWARD)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (None, 0), (5, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert 5 not in ids and 6 not in ids and None in ids and 7 in ids
