"""Fixtures of awkward rows shared by the operator tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, content string, fp long"


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 7) for i, t, s in rows], SCHEMA)


AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, "one two three four five six", "b"),
    (6, "one two three four five six", "b"), (6, "one two three four five six", "b"), (None, "loose text without id", "c"),
    (None, None, None), (7, "word " * 40_000, "a"), (8, "ÄÖ é ñ 😀 " * 50, "a"), (9, "x" * 100_000, "a"),
]


def text_of(row):
    return row[1] or ""
