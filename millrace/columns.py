"""Column names, types and roles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.FloatType, T.DoubleType))


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.StringType, T.VarcharType, T.CharType))


def numeric_names(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_numeric(df, n)]


def text_names(df: DataFrame) -> list[str]:
    return [n for n in df.columns if is_text(df, n)]


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def resolve_column(name: str | None, names: Sequence[str]) -> str | None:
    """Exact match first, then a trimmed match that ignores case."""
    wanted = (name or "").strip()
    if not wanted:
        return None
    if wanted in names:
        return wanted
    folded = {n.strip().lower(): n for n in reversed(list(names))}
    return folded.get(wanted.lower())


_WORD_EDGES = (
    (re.compile(r"[^\w\s]"), "_"),
    (re.compile(r"(?<=[A-Z])(?=[A-Z][a-z])"), "_"),
    (re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), "_"),
    (re.compile(r"[\s_]+"), "_"),
)


def snake(name: str) -> str:
    text = str(name).strip()
    for pattern, replacement in _WORD_EDGES:
        text = pattern.sub(replacement, text)
    return text.strip("_").lower()


def distinct_names(names: Sequence[str]) -> list[str]:
    """Append _2, _3 … where a name repeats (Spark compares names without case)."""
    seen: set[str] = set()
    out = []
    for name in names:
        candidate, turn = name, 1
        while candidate.lower() in seen:
            turn += 1
            candidate = f"{name}_{turn}"
        seen.add(candidate.lower())
        out.append(candidate)
    return out


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: NaN counts as missing, text that does not parse is NULL."""
    if is_fractional(df, name):
        return F.when(~F.isnan(col(name)), col(name).cast("double"))
    if is_numeric(df, name) or isinstance(type_of(df, name), T.BooleanType):
        return col(name).cast("double")
    if is_text(df, name):
        value = col(name).try_cast("double")
        return F.when(~F.isnan(value), value)
    raise ValueError(f"column {name!r} is not numeric")


def rounded(value: float, digits: int) -> float:
    """Decimal rounding with ties away from zero, as ``F.round`` does it."""
    step = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(value))).quantize(step, ROUND_HALF_UP))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of the wall-clock time of a date or timestamp, in any session zone."""
    c = col(name)
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    if isinstance(type_of(df, name), T.DateType):
        return day
    seconds = F.extract(F.lit("SECOND"), c) * 1_000_000
    return day + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + seconds.cast("long")


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c.isNull() | F.isnan(c) if is_fractional(df, name) else c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number; treat it as missing from ingest on."""
    changes = {n: F.when(~F.isnan(col(n)), col(n)) for n in df.columns if is_fractional(df, n)}
    return df.withColumns(changes) if changes else df
