"""Dates: mixed-format parsing, periods and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: date layouts tried in this order, month before day
DATE_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy",
    "M-d-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "yyyyMMdd",
)

PERIODS = {"T": "MINUTE", "H": "HOUR", "D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}


def parse_mixed(text: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """First layout that parses wins; unparsable text is NULL."""
    trimmed = F.trim(text)
    parsed = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in layouts])
    # text without a digit, or far too long, is no date; the layouts are tried on the rest only
    return F.when((F.length(trimmed) <= 40) & trimmed.rlike("[0-9]"), parsed)


def period_start(value: Column, period: str) -> Column:
    """Start of the period that holds a date or timestamp; weeks end on Sunday."""
    stamp = value.cast("timestamp_ntz")
    if period == "T":
        return F.date_trunc("MINUTE", stamp).cast("timestamp_ntz")
    if period == "H":
        return F.date_trunc("HOUR", stamp).cast("timestamp_ntz")
    day = stamp.cast("date")
    if period == "D":
        return day
    if period == "W":
        return F.date_add(F.trunc(day, "week"), 6)
    return F.trunc(day, {"M": "month", "Q": "quarter", "Y": "year"}[period])


STEPS = {
    "T": "INTERVAL 1 MINUTE",
    "H": "INTERVAL 1 HOUR",
    "D": "INTERVAL 1 DAY",
    "W": "INTERVAL 7 DAY",
    "M": "INTERVAL 1 MONTH",
    "Q": "INTERVAL 3 MONTH",
    "Y": "INTERVAL 1 YEAR",
}

_LABELS = {"D": "yyyy-MM-dd", "W": "yyyy-MM-dd", "M": "MMM yyyy", "Q": "MMM yyyy", "Y": "yyyy",
           "H": "yyyy-MM-dd HH:00", "T": "HH:mm"}


def period_label(value: Column, period: str) -> Column:
    return F.date_format(value, _LABELS.get(period, "yyyy-MM-dd"))
