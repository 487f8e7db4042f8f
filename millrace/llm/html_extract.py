"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is read as a sequence of leaf blocks (``html_blocks``). Each block has features of its ancestors
(element names, parts of class, id and role names) and of its text (length, share of links, punctuation,
words of short blocks, the same of its neighbours). The field labels every block as main text or not; its
transition weights differ between neighbours under one parent and others. The labels of a page are the best
sequence, found by the Viterbi algorithm; the main blocks are joined in page order.

Training maximises the penalised likelihood with L-BFGS on two sources of labelled pages: pages composed
from hand-labelled fragments (``labelled_pages``), and at most ``FIT_PAGES`` pages of the table, none larger
than ``FIT_BYTES``, that have exactly one ``article`` or else one ``main`` element. There a block is main if it
stands inside that element and under nothing that is named as something else. Half of the pages are also
seen without their ancestors, so the text features carry weight where markup says nothing. Every page of
the table is then labelled whole, whatever its size.

Defined cases: a NULL or empty page, or one without main blocks, gives the empty text; rows with a NULL or
repeated page_id are extracted like others; further columns are left out; an empty table gives an empty
result, and without pages to learn from only the composed ones count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices
from millrace.llm.html_blocks import Block, blocks
from millrace.llm.labelled_pages import labelled_pages

FIT_PAGES = 300
FIT_BYTES = 1 << 16
COMPOSED_PAGES = 1_200
PENALTY = 0.5
ROUNDS = 60
SHORT = 16  # words up to which a block's words are features
# Names under which nothing is main text when pages of the table are labelled.
OTHER_TAGS = frozenset("nav aside footer form dialog button fieldset menu".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement sponsored promo cookie consent banner notice popup modal menu nav navigation sidebar widget "
    "footer comment comments reply responses share social related newsletter signup subscribe breadcrumb breadcrumbs".split())
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")


class Field(NamedTuple):
    """Weights of a two-label field: per feature for the label main, per (same parent, label, label), per first label."""

    weights: dict[str, float]
    steps: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    first: tuple[float, float]


def _share(part: int, whole: int) -> int:
    ratio = part / max(whole, 1)
    return 0 if ratio == 0 else 1 if ratio < 0.25 else 2 if ratio < 0.6 else 3 if ratio < 0.95 else 4


def place_features(block: Block) -> list[str]:
    """Features of where a block stands."""
    return [f"tag:{block.tag}", *(f"in:{name}" for name in block.inside), *(f"name:{word}" for word in block.words)]


def text_features(page: list[Block]) -> list[list[str]]:
    """Features of the texts of a page's blocks and of their neighbours."""
    shapes, out = [], []
    for block in page:
        words = block.text.split()
        size, links = min(int(math.log2(len(words))), 7), _share(block.linked, len(block.text))
        shapes.append((f"{size}", f"{links}"))
        last = block.text[-1]
        own = [f"size:{size}", f"links:{links}", f"digits:{_share(len(DIGIT.findall(block.text)), len(block.text))}",
               f"stop:{last in '.!?…»”'}:{min(size, 3)}", f"commas:{min(block.text.count(','), 3)}"]
        if "©" in block.text:
            own.append("copyright")
        if len(words) <= SHORT:
            own += [f"word:{w}" for w in set(WORD.findall(block.text.lower()))]
        out.append(own)
    for i, own in enumerate(out):
        before, after = (shapes[i - 1] if i else ("start", "start")), (shapes[i + 1] if i + 1 < len(out) else ("end", "end"))
        own += [f"size-1:{before[0]}", f"links-1:{before[1]}", f"size+1:{after[0]}", f"links+1:{after[1]}"]
    return out


def _same(page: list[Block]) -> list[int]:
    """Whether a block has the same parent as the one before it."""
    return [0] + [int(a.holder == b.holder) for a, b in zip(page, page[1:])]


def best_labels(scores: list[float], same: list[int], field: Field) -> list[int]:
    """The most likely labels (Viterbi)."""
    if not scores:
        return []
    off, on = field.first[0], field.first[1] + scores[0]
    back = []
    for score, kind in zip(scores[1:], same[1:]):
        (a, b), (c, d) = field.steps[kind]
        from_off, from_on = (off + a >= on + c), (off + b > on + d)
        back.append((0 if from_off else 1, 0 if from_on else 1))
        off, on = (off + a if from_off else on + c), (off + b if from_on else on + d) + score
    label = int(on > off)
    labels = [label]
    for choice in reversed(back):
        label = choice[label]
        labels.append(label)
    return labels[::-1]


class Labeler:
    """Applies a field to pages; scores of places are kept, as few places occur on very many blocks."""

    KEPT = 20_000

    def __init__(self, field: Field):
        self.field, self.places = field, {}

    def main_blocks(self, html: str | None) -> list[str]:
        page = blocks(html or "")
        weights = self.field.weights
        scores = []
        for block, own in zip(page, text_features(page)):
            place = (block.tag, block.inside, block.words)
            known = self.places.get(place)
            if known is None:
                if len(self.places) >= self.KEPT:
                    self.places.clear()
                known = self.places[place] = sum(weights.get(f, 0.0) for f in place_features(block))
            scores.append(known + sum([weights[f] for f in own if f in weights]))
        labels = best_labels(scores, _same(page), self.field)
        return [block.text for block, label in zip(page, labels) if label]


class Sequence(NamedTuple):
    features: list[list[str]]
    same: list[int]
    labels: list[int]


def landmark_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that says itself where its main text is; None for others."""
    for name in ("article", "main"):
        inside = [name in b.inside for b in page]
        if any(inside):
            if name == "article":  # a second article may be a comment or a teaser
                runs = sum(a and not b for a, b in zip(inside, [False] + inside))
                if runs != 1:
                    return None
            return [int(i and not (b.inside & OTHER_TAGS) and not (b.words & OTHER_NAMES)) for i, b in zip(inside, page)]
    return None


def sequences(page: list[Block], labels: list[int]) -> Iterator[Sequence]:
    """A labelled page with and without its ancestors."""
    text, same = text_features(page), _same(page)
    yield Sequence([place_features(b) + t for b, t in zip(page, text)], same, labels)
    if len(page) % 2:
        yield Sequence(text, same, labels)


def train(data: list[Sequence], penalty: float = PENALTY, rounds: int = ROUNDS) -> Field:
    """The field with the largest penalised likelihood."""
    seen = Counter(f for s in data for own in s.features for f in own)
    names = sorted(f for f, n in seen.items() if n > 2)
    place = {f: i for i, f in enumerate(names)}
    data = sorted((s for s in data if s.labels), key=lambda s: -len(s.labels))
    starts = np.cumsum([0] + [len(s.labels) for s in data])
    hits = [(row, place[f]) for row, own in enumerate(own for s in data for own in s.features) for f in own if f in place]
    rows, columns = np.array(hits, np.int64).reshape(-1, 2).T
    labels = np.array([y for s in data for y in s.labels], np.int64)
    same = np.array([k for s in data for k in s.same], np.int64)
    longest = len(data[0].labels) if data else 0
    active = [sum(len(s.labels) > t for s in data) for t in range(longest)]
    at = [starts[: n] + t for t, n in enumerate(active)]
    later = np.concatenate(at[1:]) if longest > 1 else np.zeros(0, np.int64)
    width = len(names)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        steps, first = theta[width: width + 8].reshape(2, 2, 2), theta[width + 8:]
        emit = np.zeros((len(labels), 2))
        emit[:, 1] = np.bincount(rows, theta[columns], len(labels))
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[at[0]] = emit[at[0]] + first
        for t in range(1, longest):
            before = forward[at[t] - 1][:, :, None] + steps[same[at[t]]]
            forward[at[t]] = np.logaddexp(before[:, 0], before[:, 1]) + emit[at[t]]
        for t in range(longest - 1, 0, -1):
            after = steps[same[at[t]]] + (emit[at[t]] + backward[at[t]])[:, None, :]
            backward[at[t] - 1] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        whole = np.zeros(len(labels))
        ends = forward[starts[1:] - 1]
        total = np.logaddexp(ends[:, 0], ends[:, 1])
        whole += np.repeat(total, np.diff(starts))
        chance = np.exp(forward + backward - whole[:, None])
        pair = np.exp(forward[later - 1][:, :, None] + steps[same[later]] + (emit[later] + backward[later])[:, None, :]
                      - whole[later][:, None, None])
        gold = emit[np.arange(len(labels)), labels].sum() + first[labels[at[0]]].sum() \
            + steps[same[later], labels[later - 1], labels[later]].sum()
        grad = np.zeros_like(theta)
        grad[:width] = np.bincount(columns, (chance[:, 1] - labels)[rows], width)
        jump = np.array([pair[same[later] == kind].sum(axis=0) for kind in (0, 1)])
        np.subtract.at(jump, (same[later], labels[later - 1], labels[later]), 1.0)
        grad[width: width + 8] = jump.ravel()
        grad[width + 8:] = chance[at[0]].sum(axis=0) - np.bincount(labels[at[0]], minlength=2)
        return float(total.sum() - gold + penalty / 2 * theta @ theta), grad + penalty * theta

    theta = minimise(loss, np.zeros(width + 10), rounds)
    steps = theta[width: width + 8].reshape(2, 2, 2).tolist()
    kept = {f: float(w) for f, w in zip(names, theta) if abs(w) > 1e-6}
    return Field(kept, tuple(tuple(tuple(r) for r in m) for m in steps), tuple(theta[width + 8:].tolist()))


def minimise(loss, theta: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with step halving."""
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, held = -grad, []
        for s, y in reversed(past):
            share = (s @ step) / (s @ y)
            held.append(share)
            step = step - share * y
        if past:
            s, y = past[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), share in zip(past, reversed(held)):
            step = step + s * (share - (y @ step) / (s @ y))
        slope, size = grad @ step, 1.0 if past else 1.0 / max(1.0, float(np.abs(grad).sum()))
        while size > 1e-10:
            fresh, turned = loss(theta + size * step)
            if fresh <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * step, turned - grad
        theta, value, grad = theta + s, fresh, turned
        if s @ y > 1e-12:
            past = [*past[-(memory - 1):], (s, y)]
        if np.abs(grad).max() < 1e-3:
            break
    return theta


def fit(pages: DataFrame) -> Field:
    """A field trained on composed pages and on those of a bounded sample of ``pages`` that label themselves."""
    data = [s for html in labelled_pages(COMPOSED_PAGES)
            for page in [blocks(html)] for s in sequences(page, [int(b.marked) for b in page])]
    landmarks = "octet_length(html) <= {} AND (html ILIKE '%<article%' OR html ILIKE '%<main%')"
    able = pages.where(landmarks.format(FIT_BYTES)).select("html", F.xxhash64("html").alias("mark"))
    # only marks are ranked, so no task sends pages that are not chosen
    last = able.select("mark").distinct().orderBy("mark").limit(FIT_PAGES).agg(F.max("mark")).first()[0]
    sample = able.where(F.col("mark") <= F.lit(last)).dropDuplicates(["mark"]).orderBy("mark")
    for row in sample.collect():
        page = blocks(row.html)
        labels = landmark_labels(page)
        if labels:
            data += sequences(page, labels)
    return train(data)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks (main blocks) of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(field)
        for batch in batches:
            for part in slices(batch, "html"):
                main = [labeler.main_blocks(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(["\n".join(m) for m in main], pa.string()),
                     pa.array([len(m) for m in main], pa.int32())], names=["page_id", "url", "text", "n_blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    texts = pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks int")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
