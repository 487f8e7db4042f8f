"""Short text for numbers: K and M suffixes, thousands separators, money prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that mark a money column
MONEY_WORDS = ("price", "revenue", "cost", "sales", "spend", "profit")


def is_money(name: str | None) -> bool:
    folded = str(name or "").lower()
    return any(word in folded for word in MONEY_WORDS)


def _short(value: float, million_digits: int) -> str:
    if abs(value) >= 1e6:
        text, mark = f"{value / 1e6:.{million_digits}f}", "M"
    else:
        text, mark = f"{value / 1e3:.1f}", "K"
    whole, _, part = text.partition(".")
    return (whole if not part.strip("0") else text) + mark


def short_value(name: str | None, value: float) -> str:
    """Axis or card text, e.g. 1.5K or $2.25M."""
    prefix = "$" if is_money(name) else ""
    if abs(value) >= 1e3:
        return prefix + _short(value, 2)
    if prefix:
        return f"{prefix}{value:,.2f}"
    return f"{value:,.0f}" if value == int(value) else f"{value:,.2f}"


def precise_value(name: str | None, value: float) -> str:
    """Full text with thousands separators."""
    if is_money(name):
        return f"${value:,.2f}"
    return f"{value:,.0f}" if float(value).is_integer() else f"{value:,.2f}"


def brief(value: float) -> str:
    """K/M text with one decimal, two below a thousand."""
    for size, mark in ((1e6, "M"), (1e3, "K")):
        if abs(value) >= size:
            return f"{value / size:.1f}{mark}"
    return f"{value:.2f}"


def short_column(value: Column, name: str | None = None) -> Column:
    """``short_value`` as a column expression."""
    v = value.cast("double")

    def scaled(size: float, digits: int, mark: str) -> Column:
        text = F.regexp_replace(F.format_string(f"%.{digits}f", v / size), r"\.0+$", "")
        return F.concat(text, F.lit(mark))

    small = F.format_string("%,.2f", v)
    if not is_money(name):
        small = F.when(v == F.floor(v), F.format_string("%,.0f", v)).otherwise(small)
    text = (
        F.when(F.abs(v) >= 1e6, scaled(1e6, 2, "M"))
        .when(F.abs(v) >= 1e3, scaled(1e3, 1, "K"))
        .otherwise(small)
    )
    return F.when(v.isNotNull(), F.concat(F.lit("$" if is_money(name) else ""), text))
