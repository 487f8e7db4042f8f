"""Quality checks: all row-level checks of a gate run in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import as_double, col, missing, rounded
from millrace.operators.filters import coerced
from millrace.session import settle

Check = dict[str, Any]


@dataclass
class Verdict:
    type: str
    column: str | None
    severity: str
    passed: bool
    failing: int
    detail: str


def _row_check(df: DataFrame, check: Check):
    """Count of failing rows as an aggregate, or None for a check that needs grouping."""
    kind, name = check["type"], check.get("column")
    if kind == "not_null":
        return F.count_if(missing(df, name))
    if kind == "range":
        tests = []
        if check.get("min") is not None:
            tests.append(as_double(df, name) < float(check["min"]))
        if check.get("max") is not None:
            tests.append(as_double(df, name) > float(check["max"]))
        return F.count_if(tests[0] | tests[1] if len(tests) == 2 else tests[0]) if tests else F.lit(0)
    if kind == "accepted_values":
        return F.count_if(~col(name).isin([coerced(df, name, v) for v in check.get("values") or []]))
    return None


def duplicate_keys(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Per column: (values that occur more than once, rows beyond the first of each), one job."""
    if not names:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), col(n).cast("string").alias("v")) for n in names])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("name", "v").count()
    rows = counts.where("count > 1").groupBy("name").agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.col("count") - 1).alias("extra")).collect()
    found = {r["name"]: (r["keys"], r["extra"]) for r in rows}
    return {n: found.get(n, (0, 0)) for n in names}


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent; a missing key passes."""
    keys = parent.select(col(key).alias("_key")).distinct()
    return child.where(col(foreign).isNotNull()).join(keys, col(foreign) == F.col("_key"), "left_anti")


_WORDS = {
    "not_null": "{n} NULL values in column '{c}'",
    "range": "{n} values outside the range in column '{c}'",
    "accepted_values": "{n} rows with values outside the list in column '{c}'",
    "unique": "{n} duplicate keys in column '{c}'",
    "referential": "{n} rows without a parent in column '{c}'",
}


def run_checks(
    df: DataFrame, checks: Sequence[Check], parents: dict[str, DataFrame] | None = None
) -> list[Verdict]:
    picks, errors = _row_picks(df, checks)
    row = df.agg(F.count(F.lit(1)).alias("n"), *picks.values()).first().asDict()
    return _judged(df, checks, parents or {}, row, picks, errors)


def settle_checked(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, list[Verdict]]:
    """The table as a checkpoint, with verdicts from metrics observed while it was written.

    Row-level checks take no pass of their own; checks of keys (unique, referential) read the checkpoint.
    """
    picks, errors = _row_picks(df, checks)
    watched = df.observe("checks", F.count(F.lit(1)).alias("n"), *picks.values())
    held, seen = settle(watched)
    row = dict(zip(["n", *[f"c{i}" for i in picks]], seen["checks"]))
    return held, _judged(held, checks, {}, row, picks, errors)


def _row_picks(df: DataFrame, checks: Sequence[Check]) -> tuple[dict[int, Column], dict[int, str]]:
    """Aggregates of the row-level checks, and what is wrong with checks that cannot run."""
    errors: dict[int, str] = {}
    picks: dict[int, Column] = {}
    for i, check in enumerate(checks):
        name = check.get("column") or check.get("foreign_column")
        if check["type"] != "row_count" and (name is None or name not in df.columns):
            errors[i] = f"Column '{name}' does not exist"
            continue
        test = _row_check(df, check)
        if test is not None:
            picks[i] = test.alias(f"c{i}")
        elif check["type"] not in ("row_count", "unique", "referential"):
            errors[i] = f"Unknown check {check['type']!r}"
    return picks, errors


def _judged(
    df: DataFrame, checks: Sequence[Check], parents: dict[str, DataFrame], row: dict[str, int], picks: dict[int, Column],
    errors: dict[int, str],
) -> list[Verdict]:
    counts = {i: row[f"c{i}"] for i in picks}
    unique = {i: c["column"] for i, c in enumerate(checks) if c["type"] == "unique" and i not in errors}
    repeated = duplicate_keys(df, sorted(set(unique.values())))
    counts |= {i: repeated[n][0] for i, n in unique.items()}
    for i, check in enumerate(checks):
        if check["type"] == "referential" and i not in errors:
            foreign = check.get("foreign_column") or check["column"]
            parent = parents.get(check.get("parent"), df)
            counts[i] = orphans(df, foreign, parent, check["parent_column"]).count()
    return [_verdict(i, c, row["n"], counts, errors) for i, c in enumerate(checks)]


def _verdict(i: int, check: Check, rows: int, counts: dict[int, int], errors: dict[int, str]) -> Verdict:
    name = check.get("column") or check.get("foreign_column")
    detail, failing = errors.get(i, ""), counts.get(i, 0)
    if check["type"] == "row_count" and not detail:
        low, high = check.get("min_rows"), check.get("max_rows")
        if low is not None and rows < low:
            detail = f"Row count {rows} is below {low}"
        if high is not None and rows > high:
            detail = f"Row count {rows} exceeds {high}"
    elif failing and not detail:
        detail = _WORDS[check["type"]].format(n=failing, c=name)
    return Verdict(check["type"], name, check.get("severity", "error"), not detail, failing, detail or "Passed")


def gate_fails(verdicts: Sequence[Verdict]) -> bool:
    return any(not v.passed and v.severity == "error" for v in verdicts)


def verdict_table(df: DataFrame, verdicts: Sequence[Verdict]) -> DataFrame:
    rows = [(v.type, v.column, v.severity, v.passed, v.failing, v.detail) for v in verdicts]
    return df.sparkSession.createDataFrame(
        rows, "type string, column string, severity string, passed boolean, failing long, detail string")


def score_checks(df: DataFrame, checks: Sequence[Check]) -> dict[str, Any]:
    """Threshold checks with a score: null share, uniqueness (a warning) and value range."""
    picks, results = {}, {}
    known = [(i, c) for i, c in enumerate(checks) if c.get("column") in df.columns]
    for i, check in known:
        if check["type"] == "not_null_threshold":
            picks[i] = F.count_if(missing(df, check["column"])).alias(f"c{i}")
        elif check["type"] == "range_check":
            v = as_double(df, check["column"])
            low, high = check.get("min"), check.get("max")
            bad = F.lit(False)
            bad = bad | (v < float(low)) if low is not None else bad
            bad = bad | (v > float(high)) if high is not None else bad
            picks[i] = F.count_if(bad).alias(f"c{i}")
    row = df.agg(F.count(F.lit(1)).alias("n"), *picks.values()).first()
    repeated = duplicate_keys(df, sorted({c["column"] for _, c in known if c["type"] == "uniqueness_check"}))
    for i, check in enumerate(checks):
        name, kind = check.get("column"), check["type"]
        if name not in df.columns:
            status, value = "FAILED", None
        elif kind == "not_null_threshold":
            value = rounded(row[f"c{i}"] / max(row["n"], 1) * 100, 2)
            status = "PASSED" if value <= float(check.get("max_null_pct", 5.0)) else "FAILED"
        elif kind == "uniqueness_check":
            value = float(repeated[name][1])
            status = "PASSED" if value == 0 else "WARNING"
        elif kind == "range_check":
            value = float(row[f"c{i}"])
            status = "PASSED" if value == 0 else "FAILED"
        else:
            raise ValueError(f"unknown check {kind!r}")
        results[i] = {"rule": kind, "column": name, "status": status, "observed": value}
    passed = sum(r["status"] == "PASSED" for r in results.values())
    return {"overall": "PASSED" if passed == len(checks) else "WARNING", "passed": passed, "total": len(checks),
            "score": rounded(passed / max(1, len(checks)) * 100, 1), "checks": list(results.values())}
