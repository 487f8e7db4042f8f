"""Table profiles: gaps, distinct values, ranges, roles and samples, in a fixed number of jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import as_double, col, is_numeric, is_time, missing, numeric_names, rounded, text_names, type_of
from millrace.operators.aggregates import value_counts
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.stats import column_stats, distinct_counts, distinct_near, modes, null_counts, pearson


def table_profile(df: DataFrame, filename: str = "") -> dict[str, Any]:
    """Rows, columns, gaps and the quality of each column."""
    rows, gaps = null_counts(df, df.columns)
    cells = rows * len(df.columns)
    total = sum(gaps.values())
    columns = []
    for name in df.columns:
        share = rounded(gaps[name] / max(rows, 1) * 100, 1)
        columns.append({"name": name, "dtype": type_of(df, name).simpleString(), "null_pct": share,
                        "quality": rounded(100 - share, 1)})
    return {"filename": filename, "rows": rows, "cols": len(df.columns), "numeric": len(numeric_names(df)),
            "missing": total, "missing_pct": rounded(total / max(cells, 1) * 100, 1), "columns": columns}


def profile_table(df: DataFrame) -> DataFrame:
    """The per-column part as a lazy table, one aggregate and an unpivot."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, n)).alias(f"m{i}")
                                                    for i, n in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(type_of(df, n).simpleString()).alias("dtype"),
                 F.round(F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")), F.lit(0.0)), 1).alias("null_pct"))
        for i, n in enumerate(df.columns)
    ])
    return counts.select(F.inline(rows)).withColumn("quality", F.round(100 - F.col("null_pct"), 1))


def missing_table(df: DataFrame) -> DataFrame:
    """Gaps and their share (2 decimals) per column, most gaps first."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, n)).alias(f"m{i}")
                                                    for i, n in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing"),
                 F.round(F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")), F.lit(0.0)), 2).alias("missing_pct"))
        for i, n in enumerate(df.columns)
    ])
    return counts.select(F.inline(rows)).orderBy(F.desc("missing"), "column")


def describe_long(df: DataFrame, names: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns in long form."""
    names = list(names or numeric_names(df))
    stats = column_stats(df, names)
    quartiles = exact_quantiles(df, {n: [0.25, 0.5, 0.75] for n in names})
    rows = []
    for name in names:
        s, (q1, q2, q3) = stats[name], quartiles[name]
        values = {"count": float(s.known), "mean": s.mean, "std": s.std, "min": s.low, "25%": q1, "50%": q2,
                  "75%": q3, "max": s.high}
        rows += [(name, k, None if v is None else float(v)) for k, v in values.items()]
    out = df.sparkSession.createDataFrame(rows, "column string, statistic string, value double")
    return out.withColumn("value", F.round("value", digits))


def summary_table(df: DataFrame) -> DataFrame:
    """Per column: type, known cells, gaps, distinct values, range or most frequent value."""
    rows, gaps = null_counts(df, df.columns)
    numbers = numeric_names(df)
    stats = column_stats(df, numbers)
    distinct = distinct_counts(df, df.columns)
    common = modes(df, [n for n in df.columns if n not in numbers])
    out = []
    for name in df.columns:
        s = stats.get(name)
        sample = common[name][0] if name not in numbers and common[name] else None
        out.append((name, type_of(df, name).simpleString(), rows - gaps[name],
                    rounded(gaps[name] / max(rows, 1) * 100, 1), distinct[name],
                    *([None if v is None else rounded(float(v), 2) for v in (s.low, s.mean, s.high)] if s else [None] * 3),
                    sample))
    return df.sparkSession.createDataFrame(
        out, "column string, type string, non_null long, missing_pct double, unique long, min double, mean double, "
             "max double, sample string")


def describe_schema(df: DataFrame, small: int = 10) -> DataFrame:
    """Per column: type, gap share, then the values of small columns, a range, or three samples."""
    rows, gaps = null_counts(df, df.columns)
    distinct = distinct_counts(df, df.columns)
    few = [n for n in df.columns if 0 < distinct[n] <= small]
    many = [n for n in df.columns if distinct[n] > small]
    picks = [F.sort_array(F.collect_set(col(n))).cast("array<string>").alias(f"v_{i}") for i, n in enumerate(few)]
    for i, name in enumerate(many):
        if is_numeric(df, name):
            picks += [F.min(col(name)).cast("string").alias(f"lo_{i}"), F.max(col(name)).cast("string").alias(f"hi_{i}")]
    row = df.agg(*picks).first() if picks else None
    texts = {}
    for i, name in enumerate(few):
        texts[name] = "values=[" + ", ".join(row[f"v_{i}"]) + "]"
    for i, name in enumerate(many):
        if is_numeric(df, name):
            texts[name] = f"range=[{row[f'lo_{i}']}, {row[f'hi_{i}']}]"
    sampled = [n for n in many if n not in texts]
    for name, values in sample_values(df, sampled).items():
        texts[name] = "sample=[" + ", ".join(values) + "]"
    out = [(n, type_of(df, n).simpleString(), rounded(gaps[n] / max(rows, 1) * 100, 1), distinct[n], texts.get(n, "empty"))
           for n in df.columns]
    return df.sparkSession.createDataFrame(
        out, "column string, type string, null_pct double, unique long, content string")


def sample_values(df: DataFrame, names: Sequence[str], n: int = 3) -> dict[str, list[str]]:
    """The n smallest distinct values of each column as text.

    Repeated minimum aggregates: each pass finds the next value, so nothing is sorted or collected.
    """
    found: dict[str, list[str]] = {name: [] for name in names}
    for _ in range(n):
        open_ = [c for c in names if found[c] is not None]
        if not open_:
            break
        picks = []
        for i, name in enumerate(open_):
            text = col(name).cast("string")
            beyond = text > found[name][-1] if found[name] else F.lit(True)
            picks.append(F.min(F.when(beyond, text)).alias(f"v{i}"))
        row = df.agg(*picks).first()
        for i, name in enumerate(open_):
            if row[i] is not None:
                found[name].append(row[i])
    return found


def table_summaries(tables: dict[str, DataFrame]) -> DataFrame:
    """Type, gaps, distinct values and sample values of every column of every table."""
    out, spark = [], None
    for table, df in tables.items():
        spark = df.sparkSession
        rows, gaps = null_counts(df, df.columns)
        distinct = distinct_counts(df, df.columns)
        samples = sample_values(df, df.columns)
        out += [(table, rows, name, type_of(df, name).simpleString(), gaps[name], distinct[name], samples[name])
                for name in df.columns]
    return spark.createDataFrame(
        out, "table_name string, row_count long, column_name string, dtype string, null_count long, "
             "unique_count long, sample_values array<string>")


# ---- roles of columns

# fixed values: words in a column name that hint at its role or at the data set's domain
DATE_WORDS = ("date", "time", "timestamp", "created", "updated", "day", "month", "week", "year", "period", "dt", "at")
ID_WORDS = ("id", "_id", "uid", "uuid", "index", "key", "code", "zip", "phone", "postal", "roll", "batch", "no", "num",
            "number", "year", "reg", "serial")
ID_TOKENS = ("id", "no", "num", "number", "code", "roll", "batch", "year", "reg", "serial", "seq", "rank", "index",
             "ref", "emp", "student", "class", "section", "grade", "date", "time", "timestamp")
DOMAIN_WORDS = {
    "sales": ("revenue", "sales", "product", "order", "units", "price", "sku", "quantity", "invoice", "discount",
              "coupon"),
    "marketing": ("campaign", "impression", "click", "ctr", "spend", "ad", "conversion", "reach", "engagement",
                  "channel", "utm"),
    "finance": ("cost", "profit", "expense", "margin", "budget", "invoice", "payment", "debit", "credit", "balance",
                "tax"),
    "customer": ("customer", "churn", "subscription", "signup", "retention", "ltv", "nps", "support", "ticket", "user",
                 "account"),
    "hr": ("employee", "salary", "department", "hire", "attrition", "headcount", "performance", "leave", "tenure"),
    "product": ("feature", "usage", "session", "event", "dau", "mau", "retention", "cohort", "funnel", "page", "view"),
    "logistics": ("shipment", "delivery", "carrier", "warehouse", "inventory", "stock", "lead_time", "freight", "sku",
                  "fulfil"),
}


def dataset_type(names: Sequence[str]) -> str:
    """Domain whose words occur most often in the column names."""
    votes = {d: sum(w in n.lower() for n in names for w in words) for d, words in DOMAIN_WORDS.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else "general"


def id_like(df: DataFrame, name: str, distinct: int | None = None, rows: int | None = None) -> bool:
    """An identifier by name, or a whole number that has few distinct values or holds years only."""
    tokens = "|".join(map(re.escape, ID_TOKENS))
    named = re.search(rf"^(?:{tokens})|(?:{tokens})$|\s(?:{tokens})\s", re.sub(r"[\s_-]+", " ", name.lower()).strip())

    def few_or_years() -> bool:
        n, d = (rows, distinct) if None not in (rows, distinct) else (df.count(), distinct_counts(df, [name])[name])
        return d <= max(20, n * 0.05) or df.agg(F.bool_and(col(name).between(1900, 2100))).first()[0] is True

    return named is not None or (isinstance(type_of(df, name), T.IntegralType) and few_or_years())


# fixed values: shapes of dates written as text
DATE_SHAPES = (
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?Z?", r"\d{1,2}[-/]\d{1,2}[-/]\d{4}", r"\d{4}-\d{2}",
    r"[A-Za-z]{3,9} \d{1,2},? \d{4}", r"\d{1,2} [A-Za-z]{3,9} \d{4}",
)


def _time_like(df: DataFrame, names: list[str]) -> set[str]:
    """Columns all of whose known values are years (numbers) or written dates (text); one pass over all rows."""
    if not names:
        return set()
    shape = "^(" + "|".join(DATE_SHAPES) + ")$"
    picks = []
    for i, name in enumerate(names):
        good = col(name).between(1900, 2100) if is_numeric(df, name) else F.trim(col(name).cast("string")).rlike(shape)
        picks += [F.count(col(name)).alias(f"n{i}"), F.count_if(good).alias(f"g{i}")]
    row = df.agg(*picks).first()
    return {name for i, name in enumerate(names) if row[f"n{i}"] and row[f"n{i}"] == row[f"g{i}"]}


def detect_schema(df: DataFrame, importance: dict[str, float] | None = None) -> dict[str, Any]:
    """Date column, metrics and dimensions from names, types and cardinality."""
    rows = df.count()
    distinct = distinct_near(df, df.columns, rows, [max(10, rows * 0.05), max(50, rows * 0.2)])
    schema: dict[str, Any] = {"date": None, "metrics": [], "dimensions": [], "feature_importance": importance or {},
                              "dataset_type": dataset_type(df.columns), "rows": rows, "distinct": distinct}
    hinted = [n for n in df.columns if not is_time(df, n) and any(w in n.lower() for w in DATE_WORDS)]
    timed = _time_like(df, hinted)
    roles = {}
    for name in df.columns:
        share = 0.05 if is_numeric(df, name) else 0.2
        few = 0 < distinct[name] <= max(10 if is_numeric(df, name) else 50, rows * share)
        grouping = few or any(w in name.lower() for w in ID_WORDS)
        roles[name] = ("time" if is_time(df, name) or (name in timed and not is_numeric(df, name)) else
                       "dimension" if name in timed or grouping else "metric" if is_numeric(df, name) else "text")
    dated = [n for n in df.columns if roles[n] == "time" or n in timed]
    schema["date"] = dated[0] if dated else None
    schema["metrics"] = [n for n in df.columns if roles[n] == "metric"]
    schema["dimensions"] = [n for n in df.columns if roles[n] == "dimension"]
    return schema


def inspect_column(df: DataFrame, name: str, top: int = 5) -> DataFrame:
    """Gaps, distinct values, numeric range and the most frequent values of one column."""
    text = col(name).cast("string")
    filled = F.when(text != "", text)
    number = filled.try_cast("double")
    head = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(filled.isNull()).alias("nulls"),
        F.count_distinct(filled).alias("unique"), F.min(number).alias("min"), F.max(number).alias("max"),
        F.round(F.avg(number), 2).alias("mean"))
    # one row joins the few top values, so the product stays tiny
    counts = df.where(filled.isNotNull()).groupBy(filled.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    best = counts.orderBy(F.desc("count"), "value").limit(top)
    return best.crossJoin(F.broadcast(head)).withColumn("pct", F.round(F.col("count") * 100.0 / F.col("rows"), 1))


def correlation_long(df: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """(row, column, r) of the full Pearson matrix over pairwise complete rows; undefined is 0."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[pearson(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    found = {}
    for i, (a, b) in enumerate(pairs):
        r = row[f"r{i}"]
        found[(a, b)] = found[(b, a)] = 0.0 if r is None or r != r else rounded(r, digits)
    out = [(a, b, 1.0 if a == b else found[(a, b)]) for a in names for b in names]
    return df.sparkSession.createDataFrame(out, "row string, column string, r double")


def eda_profile(df: DataFrame) -> dict[str, DataFrame]:
    """Everything an exploratory report shows, as tables over the full data."""
    numbers, texts = numeric_names(df), text_names(df)
    parts = []
    for name in texts[:6]:
        best = value_counts(df, name).orderBy(F.desc("count"), col(name)).limit(15)
        parts.append(best.select(F.lit(name).alias("column"), col(name).alias("value"), "count"))
    out = {"columns": summary_table(df), "describe": describe_long(df), "missing": missing_table(df)}
    if len(numbers) > 1:
        out["correlation"] = correlation_long(df, numbers[:12])
    if parts:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        out["categories"] = whole
    return out


def report_stats(df: DataFrame) -> dict[str, DataFrame]:
    """Numbers behind a written report: numeric summary, top values, strongest correlations."""
    numbers, texts = numeric_names(df)[:12], text_names(df)[:8]
    stats = column_stats(df, numbers)
    middles = exact_quantiles(df, {n: [0.5] for n in numbers})
    rows = [(n, s.mean, middles[n][0], s.std, s.low, s.high) for n, s in stats.items() if s.known]
    spark = df.sparkSession
    out = {"numeric": spark.createDataFrame(
        rows, "column string, mean double, median double, std double, min double, max double")}
    if len(numbers) > 1:
        pairs = correlation_long(df, numbers, 12).where("row < column")
        strength = pairs.select("row", "column", F.abs("r").alias("strength"))
        out["correlations"] = strength.orderBy(F.desc("strength"), "row", "column").limit(6)
    tops = []
    for name in texts:
        counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("value")).count()
        tops.append(counts.orderBy(F.desc("count"), "value").limit(5).select(F.lit(name).alias("column"), "value", "count"))
    if tops:
        whole = tops[0]
        for part in tops[1:]:
            whole = whole.unionByName(part)
        out["top_values"] = whole
    return out
