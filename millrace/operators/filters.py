"""Row filters: rule lists, join filters, equality filters, drill-down and text search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import col, type_of

Rule = dict[str, Any]


def number(value: Any) -> int | float | None:
    """Number in a value or its text; whole numbers stay integers so scans can push them down."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    try:
        parsed = float(str(value).strip())
    except ValueError:
        return None
    return int(parsed) if parsed.is_integer() and abs(parsed) < 2**53 else parsed


def coerced(df: DataFrame, name: str, value: Any) -> Any:
    """The literal in the column's own type where that is possible."""
    kind = type_of(df, name)
    if isinstance(kind, T.NumericType):
        parsed = number(value)
        if isinstance(parsed, float) and parsed.is_integer() and isinstance(kind, T.IntegralType):
            return int(parsed)
        return value if parsed is None else parsed
    if isinstance(kind, T.BooleanType) and isinstance(value, str):
        return value.strip().lower() in ("true", "1", "yes")
    return value


def _listed(df: DataFrame, name: str, value: Any) -> list:
    items = value if isinstance(value, (list, tuple, set)) else str(value).split(",")
    return [coerced(df, name, v) for v in items]


def _text(name: str) -> Column:
    return col(name).cast("string")


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}
_NEGATED = {"!=", "not_contains", "not_in"}


def rule_predicate(df: DataFrame, rule: Rule) -> Column:
    """One rule as a two-valued predicate: a missing value fails, except under a negated rule."""
    name, op, value = rule["col"], rule.get("op", "=="), rule.get("val")
    if name not in df.columns:
        raise ValueError(f"filter column {name!r} not found")
    if op in _COMPARE:
        test = _COMPARE[op](col(name), coerced(df, name, value))
    elif op in ("contains", "not_contains"):
        test = _text(name).rlike("(?i)" + str(value))
        test = ~test if op == "not_contains" else test
    elif op == "startswith":
        test = _text(name).startswith(str(value))
    elif op == "endswith":
        test = _text(name).endswith(str(value))
    elif op in ("in", "not_in"):
        test = col(name).isin(_listed(df, name, value))
        test = ~test if op == "not_in" else test
    elif op == "is_null":
        return col(name).isNull()
    elif op == "not_null":
        return col(name).isNotNull()
    else:
        raise ValueError(f"unknown filter operator {op!r}")
    # a bare test already drops NULL rows and stays readable for scan pushdown
    return F.coalesce(test, F.lit(True)) if op in _NEGATED else test


def filter_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Left fold of rules from TRUE, so a leading OR rule keeps every row."""
    if all(str(r.get("logic", "AND")).upper() == "AND" for r in rules):
        return reduce(lambda d, r: d.where(rule_predicate(d, r)), rules, df)

    def step(mask: Column, rule: Rule) -> Column:
        test = F.coalesce(rule_predicate(df, rule), F.lit(False))
        return mask & test if str(rule.get("logic", "AND")).upper() == "AND" else mask | test

    return df.where(reduce(step, rules, F.lit(True)))


def sql_predicate(df: DataFrame, name: str, op: str, value: Any) -> Column:
    """Three-valued predicate of a procedure filter node."""
    op = op.upper().strip()
    c = col(name)
    if op in ("IS NULL", "IS NOT NULL"):
        return c.isNull() if op == "IS NULL" else c.isNotNull()
    if op in ("LIKE", "ILIKE"):
        return c.like(str(value)) if op == "LIKE" else c.ilike(str(value))
    if op in ("IN", "NOT IN"):
        test = c.isin([coerced(df, name, v) for v in value])
        return ~test if op == "NOT IN" else test
    op = {"=": "==", "<>": "!="}.get(op, op)
    if op not in _COMPARE:
        raise ValueError(f"unsupported filter operator: {op!r}")
    return _COMPARE[op](c, coerced(df, name, value))


def _like_text(value: str) -> str:
    return value.replace("\\", "\\\\")


def join_predicate(c: Column, op: str, value: Any) -> Column | None:
    """WHERE condition on a joined table; text tests ignore case. None when the rule is empty."""
    op = op.upper().strip()
    if op in ("IS_NULL", "IS_NOT_NULL"):
        return c.isNull() if op == "IS_NULL" else c.isNotNull()
    if value is None:
        return None
    text = str(value).strip()
    patterns = {"CONTAINS": f"%{text}%", "STARTS_WITH": f"{text}%", "ENDS_WITH": f"%{text}"}
    if op in patterns:
        return c.ilike(_like_text(patterns[op]))
    if op == "IN":
        items = [v.strip() for v in text.split(",") if v.strip()]
        return c.isin([v if number(v) is None else number(v) for v in items]) if items else None
    op = {"=": "==", "<>": "!="}.get(op, op)
    if op not in _COMPARE:
        return None
    parsed = number(text)
    return _COMPARE[op](c, text if parsed is None else parsed)


def equal_filters(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Chained equality filters; unknown columns are ignored."""
    for name, value in filters.items():
        if name in df.columns:
            df = df.where(col(name) == coerced(df, name, value))
    return df


def drilldown(df: DataFrame, name: str, label: Any, chart: str = "bar") -> DataFrame:
    """All rows behind a chart segment; a histogram label ``l-r`` means (l, r]."""
    if chart == "dist" and "-" in str(label)[1:]:
        cut = str(label).index("-", 1)
        low, high = float(str(label)[:cut]), float(str(label)[cut + 1 :])
        return df.where((col(name) > low) & (col(name) <= high))
    return df.where(col(name) == coerced(df, name, label))


def global_search(df: DataFrame, text: str, names: Sequence[str] | None = None) -> DataFrame:
    """Rows where any cell holds the text, whatever the case."""
    needle = text.lower()
    tests = [F.coalesce(F.lower(_text(n)).contains(needle), F.lit(False)) for n in names or df.columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def numeric_or_text_compare(df: DataFrame, name: str, op: str, value: Any) -> DataFrame:
    """One comparison of a "where" question; an unknown operator means equality."""
    return df.where(_COMPARE.get(op, _COMPARE["=="])(col(name), coerced(df, name, value)))


def complete_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names))


