"""Token counts, personal data, language and toxicity against direct computation."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import languages, pii, token_counts, toxicity
from millrace.llm.common import read_table

from ..conftest import DATA
from .helpers import AWKWARD, table, text_of

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder(BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's 1.\n\t  é😀<|endoftext|>")), max_size=60))
def test_words_add_up_to_the_library_count(library, encoder, text):
    assert encoder.counts([text]) == [library(text)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text_counts_as_the_library_counts(library, encoder, text):
    assert encoder.counts([text]) == [library(text)]


def test_token_counts_awkward_rows(spark, library):
    rows = AWKWARD + [(20, "<|endoftext|> a  b \n c", "a"), (21, " lead and trail ", "a")]
    got = token_counts.token_counts(table(spark, rows), BPE).collect()
    want = sorted((str(i), len(text_of(r).encode()), library(text_of(r)), library(text_of(r)) > 512)
                  for r in rows for i in [r[0]])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_cache_is_used_and_extended(spark, tmp_path, monkeypatch):
    docs = table(spark, [(1, "alpha beta", "a"), (2, "alpha beta", "a"), (3, "gamma", "a")])
    cache = str(tmp_path / "cache")
    first = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BPE, cache).collect()}
    assert spark.read.parquet(cache).count() == 2
    # a stored count is believed: nothing that is stored is encoded again
    stored = spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("long"))
    other = str(tmp_path / "other")
    stored.write.parquet(other)
    more = docs.unionByName(table(spark, [(4, "delta delta", "a")]))
    second = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, BPE, other).collect()}
    assert [second[i] for i in (1, 2, 3)] == [99, 99, 99] and second[4] == first[1] * 0 + second[4] != 99
    assert spark.read.parquet(other).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = ["Hello  World", "a b c", "", "ünïcode text\nlines"]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    assert [r.n_tokens for r in token_counts.token_counts(docs, path).orderBy("doc_id").collect()] == want


# -- personal data ---------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def brute_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and brute_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("0123456789.-+ ()@ab%é")), max_size=70))
def test_base_spans_equal_the_patterns(text):
    assert pii.written(pii.base_spans(text)) == brute_base(text)


def test_base_spans_of_planted_values():
    card = "4111 1111 1111 1111"
    text = f"mail é a.b+c@x-y.co.uk, {card}; +49 (0)30 1234-567, 10.0.0.255 and 1.2.3.256 a@b.c@d.e"
    assert pii.written(pii.base_spans(text)) == brute_base(text)
    assert {s.kind for s in pii.base_spans(text)} == set(pii.BASE_KINDS)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "a@" * 50_000, "+1" + " " * 100_000):
        pii.base_spans(text)


def test_pii_query_rows(spark):
    rows = AWKWARD + [(30, "call 555-123-4567 or token = \"a1b2c3d4e5f60718293a4b5c\" x@y.org", "a")]
    docs = table(spark, rows)
    got = pii.find_spans(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    base = {r.doc_id: r for r in got}
    last = base[30]
    assert last.base_sha256 == hashlib.sha256(brute_base(rows[-1][1]).encode()).hexdigest() and last.n_email == 1
    assert "secret:" in last.spans
    assert pii.find_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("inner", ["", "4111111111111111x", "/+49301234567/"])
def test_long_credentials_are_masked_whole(inner):
    key = "aB3dE5fG7h" * 30 + inner + "zY9xW8vU7t" * 10
    text = f"api_token={key} and more"
    assert pii.extra_candidates(text, pii.base_spans(text)) == [pii.Span("secret", 10, 10 + len(key))]
    model = pii.Model({("bias",): 1.0}, {})
    assert pii.masked(text, pii.all_spans(text, model)[1]) == "api_token=[SECRET] and more"
    long = "key=" + "a1" * 100_000
    assert pii.extra_candidates(long, []) == [pii.Span("secret", 4, len(long))]


def plain_candidates(text, base):
    """The candidates by comparing every one with all base and taken spans."""
    found = [pii.Span("phone", *m.span()) for m in pii.NATIONAL.finditer(text)]
    found += [pii.Span("email", *m.span()) for m in pii.SPELLED.finditer(text)]
    found += [pii.Span("card", *m.span()) for m in pii.CARD.finditer(text)
              if m.end() - m.start() >= 13 and 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
    found += [pii.Span("secret", *m.span(1)) for m in pii.SECRET.finditer(text)]
    free = []
    for span in sorted(found, key=pii._order):
        held = [s for s in base if span.kind != "secret" or (s.start <= span.start and span.end <= s.end)]
        if all(span.end <= s.start or span.start >= s.end for s in [*held, *free]):
            free.append(span)
    return free


def test_candidates_equal_the_plain_comparison():
    pick = random.Random(5)
    pieces = ["555-123-4567", "+1 555 123 4567", "4111111111111111", "4111 1111 1111 1112", "token=abcdEFGH12345678", "a@b.org",
              "me [at] site.com", "10.0.0.1", " ", " ", "x", "key: 4111111111111111zz", ",", "=", "1234567890123"]
    for _ in range(400):
        text = "".join(pick.choices(pieces, k=pick.randint(1, 14)))
        base = pii.base_spans(text)
        assert pii.extra_candidates(text, base) == plain_candidates(text, base), text


def test_many_spans_in_one_text_take_linear_time():
    text = "555-123-4567 a@b.org, " * 8_000
    started = time.perf_counter()
    base = pii.base_spans(text)
    assert len(base) == 8_000 and len(pii.extra_candidates(text, base)) == 8_000
    assert time.perf_counter() - started < 1.5


def test_em_prefers_labelers_that_agree():
    counts = {("secret", 1, 1, 1, 3): 80, ("secret", 1, 1, 0, 3): 20, ("secret", -1, -1, 0, 3): 100, ("secret", -1, -1, -1, 3): 50}
    model = pii.train(counts)
    assert model.accepts(("secret", 1, 1, 1, 3)) and not model.accepts(("secret", -1, -1, 0, 3))
    assert all(0 < hit <= 1 and 0 < miss <= 1 for hit, miss in model.reliability["secret"])


def test_masking_keeps_everything_else(spark):
    docs = table(spark, [(1, "write to x@y.org now", "a"), (2, "nothing here", "a"), (3, None, "b")])
    got = {r.doc_id: r for r in pii.mask_texts(docs).collect()}
    assert got[1].text == "write to [EMAIL] now" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here" and got[3].text is None and pii.mask_texts(docs).columns == docs.columns


# -- language --------------------------------------------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(spark):
    docs = read_table(spark, DATA, "documents")
    model = languages.fit(docs.where(~languages.held_out()))
    found = languages.identify(docs, model).join(docs.where(languages.held_out()).select("doc_id", "lang"), "doc_id")
    good, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and good / n > 0.95


def test_mixture_finds_both_languages(spark):
    docs = read_table(spark, DATA, "documents")
    model = languages.fit(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 1500").collect()}
    mixed = texts["en"][:1000] + " " + texts["de"][:1000]
    shares = dict(zip(model.languages, languages.mixture(languages.cells_of(mixed), model)))
    assert shares["en"] > 0.3 and shares["de"] > 0.3 and abs(sum(shares.values()) - 1) < 1e-6


def test_em_reaches_the_brute_force_optimum():
    rng = np.random.default_rng(3)
    chances, counts = rng.random((30, 2)), rng.integers(1, 9, 30).astype(float)
    shares, best = languages._shares(chances, counts, np.array([0.5, 0.5]))
    grid = max(float(counts @ np.log(chances @ np.array([p, 1 - p]))) for p in np.linspace(0.001, 0.999, 999))
    assert best >= grid - 1e-2


def test_language_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    model = languages.fit(docs)
    got = languages.identify(docs, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = languages.fit(docs.where("false"))
    assert {r.lang_pred for r in languages.identify(docs, nothing).collect()} == {"und"}
    assert languages.identify(docs.limit(0), model).count() == 0


# -- toxicity --------------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_equal_edit_distance():
    rng = random.Random(4)
    terms = [("".join(rng.choices("abc", k=rng.randint(5, 8))), False) for _ in range(12)] + [("zzabz", True), ("ab", False)]
    words = ["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(3000)] + ["zzabzcc", "zzab", "ab", "abb", ""]
    for term, prefix in terms:
        if not prefix:
            for _ in range(20):
                at, letter = rng.randrange(len(term)), rng.choice(string.ascii_lowercase)
                words += [term[:at] + term[at + 1:], term[:at] + letter + term[at:], term[:at] + letter + term[at + 1:]]
    best, cost = toxicity.Trie(terms).match(words)
    for word, found, paid in zip(words, best, cost):
        want = {}
        for number, (term, prefix) in enumerate(terms):
            d = (0 if word.startswith(term) else 9) if prefix else edits(word, term)
            if d <= (1 if len(term) >= toxicity.FUZZY_FROM and not prefix else 0):
                want.setdefault(d, []).append(number)
        if want:
            assert paid == min(want) and found == min(want[min(want)]), word
        else:
            assert found == -1, word


def labelled(spark):
    rng = random.Random(9)
    plain = "green river stone cloud paper window garden yellow market simple".split()
    bad = ["vilified", "odious"]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(plain, k=30)
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(i % 4 == 0)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_spellings_and_quotation(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where(toxicity.training()))
    probe = table(spark, [
        (1, "you vilified odious vilified thing", "a"), (2, "you vilifi3d odiuos odiious vilifed thing", "a"),
        (3, "green river stone", "a"), (4, None, "a"), (5, 'he said the word "odious" once', "a"), (6, "odious garden", "a")])
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] > 0.9 and got[2] > 0.5 and got[3] < 0.1 and got[4] < 0.1 and got[5] < got[6]
    kept = toxicity.drop_toxic(probe, model)
    assert kept.columns == probe.columns and {3, 4} <= {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()}


def test_toxicity_held_out_accuracy(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.training()))
    found = toxicity.score(docs, model).join(labels.where(~toxicity.training()), "doc_id")
    right, n = found.agg(F.sum(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.93


def test_toxicity_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_toxicity_white_space_before_a_hit(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where(toxicity.training()))
    texts = [f"{blank}{word} now and then" for blank in (" ", "  ", "\t", "\n\n", "\u00a0") for word in ("odious", "you vilified")]
    probe = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = [r.score for r in toxicity.score(probe, model).orderBy("doc_id").collect()]
    plain = table(spark, [(i, t.strip(), "a") for i, t in enumerate(texts)])
    assert got == [r.score for r in toxicity.score(plain, model).orderBy("doc_id").collect()]


def test_toxicity_repeated_ids_weigh_as_rows(spark):
    x = np.array([[1.0, 0.0], [1.0, 2.0], [1.0, 1.0]])
    y, times = np.array([0.0, 1.0, 1.0]), np.array([5.0, 3.0, 1.0])
    again = np.repeat(np.arange(3), times.astype(int))
    assert np.allclose(toxicity._logistic(x, y, times), toxicity._logistic(x[again], y[again], np.ones(9)))
