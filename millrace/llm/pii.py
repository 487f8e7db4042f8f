"""Personal data by weak supervision.

Base spans follow fixed patterns and always stay. Looser patterns propose further candidates:
national phone numbers, spelled-out mail addresses, long numbers that fail the check digit and
credentials. Every candidate, base or not, gets three votes (yes, no or none): a regex labeler looks
at its own shape, a gazetteer labeler at lists of issuers, endings and key names, a context labeler at
the words around it. Expectation-maximisation over the counts of all vote patterns of the corpus
estimates how reliable each labeler is for each kind (Dawid and Skene, 1979), and the posteriors train
a logistic span classifier, which decides on the candidates that are not base. The driver sees counts
of vote patterns only, whose number is fixed (kinds x 27 votes x 4 length classes).

Defined cases: NULL counts as the empty text and has no span; equal rows get equal results; an empty
table gives an empty result and the starting reliabilities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
VOTES = 3
ROUNDS = 40
AROUND = 40

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so looking back changes nothing but the time
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![\w+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,24}){1,3}\b")
SECRET = re.compile(r"(?<!\w)(?:[A-Za-z_]{0,20}(?:token|key|secret|password))\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/=-]{16,})", re.I)

# fixed values: endings, issuer digits, calling codes and words that speak for a kind
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu"}
ISSUERS = {"3", "4", "5", "6"}
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52",
           "54", "55", "56", "57", "61", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "353", "358")
KEY_NAMES = ("token", "api", "secret", "password", "access", "auth")
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "key", "secret", "password", "bearer", "auth"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Every address lies around one ``@``, so the text is read once from sign to sign."""
    done = 0
    at = text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        start = at
        if host:
            back = LOCAL.match(text[done:at][::-1])
            start = at - back.end() if back else at
        if host and start < at:
            done = host.end()
            yield Span("email", start, done)
            at = text.find("@", done)
        else:
            # what precedes this sign is no part of a later address
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed; matches that fail a check are dropped."""
    spans = list(_emails(text))
    spans += [Span("ip", *m.span()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", *m.span()))
    if "+" in text:
        spans += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span.start, KINDS.index(span.kind), span.end


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def extra_candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of the looser patterns that touch no base span and not one another; a credential may hold base spans."""
    found = [Span("phone", *m.span()) for m in NATIONAL.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [Span("email", *m.span()) for m in SPELLED.finditer(text)]
    found += [Span("card", *m.span()) for m in CARD.finditer(text)
              if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19]
    found += [Span("secret", *m.span(1)) for m in SECRET.finditer(text)]
    # one sweep by start: of earlier spans only the furthest end matters
    starts = [s.start for s in base]
    furthest = list(accumulate((s.end for s in base), max))
    free, end = [], 0
    for span in sorted(found, key=_order):
        if span.start < end:
            continue
        # what a base span hides only in part stays a candidate as a whole if it is a credential
        if span.kind == "secret":
            before = bisect_right(starts, span.start)
            hidden = before > 0 and furthest[before - 1] >= span.end
        else:
            before = bisect_left(starts, span.end)
            hidden = before > 0 and furthest[before - 1] > span.start
        if not hidden:
            free.append(span)
            end = span.end
    return free


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """Regex, gazetteer and context vote: 1 for, -1 against, 0 no opinion."""
    kind, body = span.kind, text[span.start: span.end]
    digits = _digits(body)
    before = text[max(0, span.start - AROUND): span.start].lower()
    after = text[span.end: span.end + AROUND].lower()
    if base:
        shape = 1
    elif kind == "phone":
        shape = 1 if len(digits) == 10 and body.count("-") + body.count(" ") + body.count(".") == 2 else 0
    elif kind == "card":
        shape = -1
    elif kind == "secret":
        shape = 1 if len(set(body)) >= 8 and digits and re.search("[A-Za-z]", body) else -1
    else:
        shape = 0
    if kind == "email":
        listed = 1 if re.split(r"[^A-Za-z]+", body)[-1].lower() in ENDINGS else 0
    elif kind == "card":
        listed = 1 if digits[:1] in ISSUERS else -1
    elif kind == "phone":
        listed = 1 if base and digits.startswith(CALLING) else 0
    elif kind == "secret":
        listed = 1 if any(name in before for name in KEY_NAMES) else -1
    else:
        listed = -1 if body.startswith(("0.", "127.", "255.")) else 0
    near = before + " " + after
    if any(cue in near for cue in CUES[kind]):
        context = 1
    else:
        joined = (before[-1:].isalnum() or after[:1].isalnum())
        context = -1 if joined else 0
    return shape, listed, context


def _pattern(text: str, span: Span, base: bool) -> tuple:
    return (span.kind, *votes(text, span, base), min(3, (span.end - span.start) // 8))


class Model(NamedTuple):
    """Weights of the span classifier and what expectation-maximisation said about the labelers."""

    weights: dict[tuple, float]
    reliability: dict[str, list[tuple[float, float]]]

    def accepts(self, pattern: tuple) -> bool:
        return sum(self.weights.get(f, 0.0) for f in _features(pattern)) >= 0.0


def _features(pattern: tuple) -> list[tuple]:
    kind, *rest = pattern
    return [("bias",), ("kind", kind), *[("vote", i, v) for i, v in enumerate(rest[:VOTES])], ("size", rest[VOTES])]


def _posteriors(counts: dict[tuple, int]) -> tuple[dict[tuple, float], list[tuple[float, float]]]:
    """Two-class expectation-maximisation over vote patterns with Laplace smoothing."""
    rows = [(p, n) for p, n in counts.items()]
    values = np.array([p[1: 1 + VOTES] for p, _ in rows]) + 1
    weight = np.array([n for _, n in rows], float)
    # chance of voting no, none, yes for true and for false candidates; labelers start as better than chance
    true = np.tile([0.1, 0.3, 0.6], (VOTES, 1))
    false = np.tile([0.6, 0.3, 0.1], (VOTES, 1))
    prior = 0.5
    for _ in range(ROUNDS):
        yes = np.log(prior) + np.log(true[np.arange(VOTES), values]).sum(axis=1)
        no = np.log(1 - prior) + np.log(false[np.arange(VOTES), values]).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        prior = (weight @ post + 1) / (weight.sum() + 2)
        for i in range(VOTES):
            for v in range(3):
                hit = values[:, i] == v
                true[i, v] = weight[hit] @ post[hit] + (0.1, 0.3, 0.6)[v] * 10
                false[i, v] = weight[hit] @ (1 - post[hit]) + (0.6, 0.3, 0.1)[v] * 10
            true[i] /= true[i].sum()
            false[i] /= false[i].sum()
    return {p: float(x) for (p, _), x in zip(rows, post)}, [(float(t[2]), float(f[0])) for t, f in zip(true, false)]


def train(counts: dict[tuple, int]) -> Model:
    """Posteriors per kind, then one logistic classifier over all patterns."""
    posterior: dict[tuple, float] = {}
    reliability = {}
    for kind in KINDS:
        own = {p: n for p, n in counts.items() if p[0] == kind}
        if own:
            found, reliability[kind] = _posteriors(own)
            posterior |= found
    names = sorted({f for p in posterior for f in _features(p)}, key=repr)
    if not names:
        return Model({}, {})
    place = {f: i for i, f in enumerate(names)}
    patterns = sorted(posterior)
    x = np.zeros((len(patterns), len(names)))
    for row, p in enumerate(patterns):
        x[row, [place[f] for f in _features(p)]] = 1
    y = np.array([posterior[p] for p in patterns])
    n = np.log1p(np.array([counts[p] for p in patterns], float))
    w = np.zeros(len(names))
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 0.01 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(names))
        w = w + np.linalg.solve(curve, gradient)
    return Model({f: float(w[i]) for f, i in place.items()}, reliability)


def fit(docs: DataFrame) -> Model:
    """Model from the vote patterns of all candidates of all texts."""
    schema = "kind string, a int, b int, c int, size int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    seen.update(_pattern(text, s, True) for s in base)
                    seen.update(_pattern(text, s, False) for s in extra_candidates(text, base))
        keys = list(seen)
        columns = [pa.array([k[0] for k in keys], pa.string())]
        columns += [pa.array([k[i] for k in keys], pa.int32()) for i in range(1, 5)]
        columns.append(pa.array([seen[k] for k in keys], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "c", "size", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(count, schema)
    total = rows.groupBy("kind", "a", "b", "c", "size").agg(F.sum("n").alias("n")).collect()
    return train({tuple(r)[:5]: r["n"] for r in total})


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the accepted candidates."""
    base = base_spans(text)
    more = [s for s in extra_candidates(text, base) if model.accepts(_pattern(text, s, False))]
    return base, sorted(base + more, key=_order)


def find_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans for every row of ``docs`` (doc_id, text)."""
    model = model or fit(docs)
    names = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [all_spans(t, model) for t in part.column("text").to_pylist()]
                held = [Counter(s.kind for s in base) for base, _ in found]
                columns = [part.column("doc_id")]
                columns += [pa.array([h[k] for h in held], pa.int64()) for k in BASE_KINDS]
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                columns += [pa.array(digests, pa.string()), pa.array([written(s) for _, s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first start wins."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at: span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def mask_texts(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with all spans replaced in ``text``, and ``n_chars`` (if there) counted anew for changed rows."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns, names = list(part.columns), part.schema.names
                at = names.index("text")
                texts = columns[at].to_pylist()
                spans = [all_spans(t, model)[1] if t else [] for t in texts]
                fresh = [masked(t, s) if s else t for t, s in zip(texts, spans)]
                columns[at] = pa.array(fresh, columns[at].type)
                if "n_chars" in names:
                    place = names.index("n_chars")
                    old = columns[place].to_pylist()
                    sizes = [len(t) if s else n for t, s, n in zip(fresh, spans, old)]
                    columns[place] = pa.array(sizes, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
