"""Candidate join keys between tables, from names, types and distinct shares."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame

from millrace.columns import is_numeric, snake
from millrace.operators.stats import distinct_near

# fixed values: words that mark a column as a key, and names of a table's own key
KEY_WORDS = frozenset(("id", "ids", "key", "code", "num", "no", "uuid", "pk"))
OWN_KEYS = frozenset((("id",), ("pk",), ("key",)))
UNIQUE_SHARE = 0.98
MIN_CONFIDENCE = 0.65


class Name(NamedTuple):
    """A column name in words: ``CustomerID`` of orders is ("customer", "id")."""

    table: tuple[str, ...]
    words: tuple[str, ...]

    @property
    def is_key(self) -> bool:
        return any(w in KEY_WORDS or w.endswith(("key", "code", "uuid")) for w in self.words)

    @property
    def subject(self) -> tuple[str, ...]:
        return tuple(w for w in self.words if w not in KEY_WORDS)


def _named(table: str, column: str) -> Name:
    return Name(tuple(snake(table).split("_")), tuple(snake(column).split("_")))


def _refers(a: Name, b: Name) -> bool:
    """Whether a names the own key of b's table."""
    return b.words in OWN_KEYS and a.is_key and a.subject in (b.table, (*b.table[:-1], b.table[-1].removesuffix("s")))


def _overlap(a: Name, b: Name) -> bool:
    shared = set(a.subject) & set(b.subject)
    return bool(shared) and len(shared) == min(len(set(a.subject)), len(set(b.subject)))


# what two names can have in common, with the confidence that this gives
RULES: tuple[tuple[float, str, Callable[[Name, Name], bool]], ...] = (
    (0.98, "{left} points to the key of {right_table}", _refers),
    (0.98, "{right} points to the key of {left_table}", lambda a, b: _refers(b, a)),
    (0.95, "both tables have the key {left}", lambda a, b: a.words == b.words and a.is_key),
    (0.85, "the keys {left} and {right} are about the same thing", lambda a, b: a.is_key and b.is_key and _overlap(a, b)),
    (0.70, "both tables have a column {left}", lambda a, b: a.words == b.words),
)


def name_match(left_table: str, left: str, right_table: str, right: str) -> tuple[float, str]:
    """Confidence and reason of the strongest rule that two columns meet; 0 when they meet none."""
    a, b = _named(left_table, left), _named(right_table, right)
    score, text = max(((s, t) for s, t, test in RULES if test(a, b)), default=(0.0, ""), key=lambda r: r[0])
    return score, text.format(left=left, right=right, left_table=left_table, right_table=right_table)


def _cardinality(left: float, right: float) -> str:
    many_left, many_right = left < UNIQUE_SHARE, right < UNIQUE_SHARE
    return f"{'many' if many_left else 'one'}_to_{'many' if many_right else 'one'}"


def infer_relationships(tables: dict[str, DataFrame]) -> DataFrame:
    """All candidate pairs, most confident first. Only columns that match by name are counted."""
    matches = []
    for (t1, d1), (t2, d2) in combinations(tables.items(), 2):
        for c1 in d1.columns:
            for c2 in d2.columns:
                score, reason = name_match(t1, c1, t2, c2)
                if score >= MIN_CONFIDENCE:
                    if is_numeric(d1, c1) != is_numeric(d2, c2):
                        score *= 0.5
                    matches.append((t1, c1, t2, c2, round(score, 2), reason))
    wanted: dict[str, set[str]] = {}
    for t1, c1, t2, c2, _, _ in matches:
        wanted.setdefault(t1, set()).add(c1)
        wanted.setdefault(t2, set()).add(c2)
    share = {}
    for table, names in wanted.items():
        rows = tables[table].count()
        counts = distinct_near(tables[table], sorted(names), rows, [rows * UNIQUE_SHARE])
        share |= {(table, n): c / max(rows, 1) for n, c in counts.items()}
    rows = [(t1, c1, t2, c2, score, _cardinality(share[(t1, c1)], share[(t2, c2)]), reason)
            for t1, c1, t2, c2, score, reason in sorted(matches, key=lambda m: -m[4])]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "left_table string, left_column string, right_table string, right_column string, confidence double, "
              "cardinality string, reason string")
