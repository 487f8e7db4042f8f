"""Nested records: dotted columns and paths into JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import quoted


def _leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    out = []
    for field in kind.fields:
        here = (*path, field.name)
        out += _leaves(field.dataType, here) if isinstance(field.dataType, T.StructType) else [here]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns; arrays stay values."""
    paths = _leaves(df.schema, ())
    if all(len(p) == 1 for p in paths):
        return df
    return df.select(*[F.col(".".join(quoted(s) for s in p)).alias(".".join(p)) for p in paths])


def explode_records(df: DataFrame, name: str) -> DataFrame:
    """One row per element of an array of objects, the other columns repeated."""
    others = [F.col(quoted(c)) for c in df.columns if c != name]
    kind = df.schema[name].dataType.elementType
    row = df.select(*others, F.explode_outer(F.col(quoted(name))).alias("_item"))
    if not isinstance(kind, T.StructType):
        return row.withColumnRenamed("_item", name)
    return row.select(*others, F.col("_item.*"))


def json_path(path: str) -> str:
    """``result.items.0.id`` as a JSONPath."""
    steps = [f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split(".") if s]
    return "$" + "".join(steps)


def dig(text: Column, path: str | None) -> Column:
    """The value at a dotted path of JSON text, as text; a digit step indexes a list."""
    return F.get_json_object(text, json_path(path)) if path else text


def dig_records(df: DataFrame, name: str, path: str | None, schema: T.StructType | str) -> DataFrame:
    """Records of a list inside JSON text, one row each, with a declared record schema."""
    record = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_json(dig(F.col(quoted(name)), path), f"array<{record}>")
    others = [F.col(quoted(c)) for c in df.columns if c != name]
    return df.select(*others, F.inline(parsed))
