"""Language identification as inference over a mixture of languages.

Letter n-grams (three UTF-8 bytes of the lower-cased text, everything but letters read as a blank) are
counted for every language over all rows to learn from; the counts are hashed into a fixed number of
cells, so the model has languages x CELLS numbers whatever the corpus holds. Each document is then a
mixture: expectation-maximisation estimates what share of its n-grams each language explains, and
languages leave the set, least share first, while the penalised likelihood (half the logarithm of
the number of n-grams for each language) does not fall. The largest share names the document.

Defined cases: NULL, empty and letterless texts give ``und`` with score 0; so does every text if there
is nothing to learn from; ties go to the first language in alphabetical order; rows with a NULL id are
predicted but neither learned from nor held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_of

CELL_BITS = 15
CELLS = 1 << CELL_BITS
SMOOTH = 0.5
MOST_ROUNDS = 60
CLOSE = 1e-4
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
# bytes of ASCII that are no letters become blanks; all others stay
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def cells_of(text: str) -> np.ndarray:
    """Cell of every n-gram of a text, repeats included."""
    data = np.frombuffer(b" " + text.lower().encode().translate(BLANKED) + b" ", np.uint8).astype(np.uint32)
    gram = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    kept = gram[(data[1:-1] != 32) | ((data[:-2] != 32) & (data[2:] != 32))]
    return ((kept * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)).astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    chances: np.ndarray  # cells x languages


def held_out(share: int = 3, left: int = 1) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(share)) == left


def fit(docs: DataFrame) -> Model:
    """Model from all rows of ``docs`` (text, lang) with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    sums = held.setdefault(lang, np.zeros(CELLS, np.int64))
                    np.add(sums, np.bincount(cells_of(text), minlength=CELLS), out=sums)
        for lang, sums in held.items():
            cell = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(sums[cell])],
                names=["lang", "cell", "n"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    sums = np.full((CELLS, len(languages)), SMOOTH)
    place = {name: i for i, name in enumerate(languages)}
    np.add.at(sums, (table.column("cell").to_numpy(), np.array([place[n] for n in names], int)), table.column("n").to_numpy())
    return Model(languages, sums / sums.sum(axis=0) if languages else sums)


def _shares(chances: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood shares and their log-likelihood."""
    total, shares = counts.sum(), start
    for _ in range(MOST_ROUNDS):
        fresh = shares * ((counts / (chances @ shares)) @ chances) / total
        moved = np.abs(fresh - shares).max()
        shares = fresh
        if moved < CLOSE:
            break
    return shares, float(counts @ np.log(chances @ shares))


def mixture(cells: np.ndarray, model: Model) -> np.ndarray:
    """Share of each language of the model; those outside the selected set have none."""
    which, counts = np.unique(cells, return_counts=True)
    chances = model.chances[which]
    chances = chances / chances.max(axis=1, keepdims=True)
    counts = counts.astype(float)
    charge = 0.5 * np.log(counts.sum())
    chosen = np.arange(len(model.languages))
    shares, fit_now = _shares(chances, counts, np.full(len(chosen), 1 / len(chosen)))
    while len(chosen) > 1:
        keep = np.arange(len(chosen)) != np.argmin(shares)
        left = shares[keep]
        start = left / left.sum() if left.sum() > 0 else np.full(len(left), 1 / len(left))
        fewer, fit_fewer = _shares(chances[:, chosen[keep]], counts, start)
        if fit_fewer + charge < fit_now:
            break
        chosen, shares, fit_now = chosen[keep], fewer, fit_fewer
    out = np.zeros(len(model.languages))
    out[chosen] = shares
    return out


def predict(text: str, model: Model) -> tuple[str, float]:
    if not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0
    shares = mixture(cells_of(text), model)
    best = int(np.argmax(shares))
    return model.languages[best], float(min(1.0, max(0.0, shares[best])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [predict(t, model) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
