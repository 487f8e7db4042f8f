"""Scalar formulas and text, number and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions.dates import parse_mixed, period_start
from millrace.functions.formats import short_column
from millrace.functions.formula import derive
from millrace.functions.text import replace_pattern


def _formulas(df, keep, formulas, digits=6):
    for name, text in formulas.items():
        df = derive(df, name, text)
    kinds = dict(df.dtypes)
    shown = [F.round(n, digits).alias(n) if kinds[n] == "double" else F.col(n) for n in formulas]
    return df.select(*keep, *shown)


@query("derive", """
    SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def derive_query(t):
    return _formulas(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"],
                     {"charge": "L_EXTENDEDPRICE * (1 - l_discount) * (1 + l_tax)"}, 6)


@query("fx_arith", """
    SELECT p_partkey, p_size + 2 * 3 - 1 AS a, ROUND(p_size / 7, 6) AS b, p_size % 7 AS c, ROUND(power(p_size, 2) + 1, 6) AS d, -p_size AS e,
      CASE WHEN p_size % 5 = 0 THEN NULL ELSE ROUND(100 / NULLIF(p_size % 5, 0)::DOUBLE, 6) END AS f FROM part""")
def fx_arith(t):
    return _formulas(t.part, ["p_partkey"], {"a": "p_size + 2 * 3 - 1", "b": "p_size / 7", "c": "p_size % 7",
                                             "d": "p_size ^ 2 + 1", "e": "-p_size", "f": "100 / (p_size % 5)"})


@query("fx_compare", """
    SELECT p_partkey, p_size > 10 AS a, p_size BETWEEN 5 AND 15 AS b, NOT (p_size <= 20) AS c, p_name <> 'hot rod' AS d,
      p_size >= 10 AND p_size < 20 OR p_brand = 'Brand#1' AS e FROM part""")
def fx_compare(t):
    return _formulas(t.part, ["p_partkey"], {
        "a": "p_size > 10", "b": "p_size BETWEEN 5 AND 15", "c": "NOT (p_size <= 20)", "d": "p_name <> 'hot rod'",
        "e": "p_size >= 10 AND p_size < 20 OR p_brand = 'Brand#1'"})


@query("fx_cond", """
    SELECT p_partkey, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS a, NULLIF(p_size, 10) AS b,
      COALESCE(NULLIF(p_size, 10), -1) AS c, GREATEST(p_size, 25) AS d, LEAST(p_size, 25, NULLIF(p_size, 5)) AS e, IFNULL(NULLIF(p_type, 'SMALL'), 'none') AS f FROM part""")
def fx_cond(t):
    return _formulas(t.part, ["p_partkey"], {
        "a": "CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END", "b": "nullif(p_size, 10)",
        "c": "coalesce(nullif(p_size, 10), -1)", "d": "greatest(p_size, 25)", "e": "least(p_size, 25, nullif(p_size, 5))",
        "f": "ifnull(nullif(p_type, 'SMALL'), 'none')"})


@query("fx_math", """
    SELECT p_partkey, abs(p_size - 25) AS a, ROUND(sqrt(p_size), 6) AS b, ROUND(cbrt(p_size), 6) AS c, ROUND(ln(p_size), 6) AS d, ROUND(log(p_size), 6) AS e,
      ROUND(log2(p_size), 6) AS f, ROUND(log10(p_size), 6) AS g, ROUND(exp(p_size / 50.0), 6) AS h, CAST(floor(p_retailprice / 3) AS BIGINT) AS i, CAST(ceil(p_retailprice / 3) AS BIGINT) AS j,
      ROUND(pow(p_size, 0.5), 6) AS k, mod(p_size, 4) AS l, ROUND(pi() * p_size, 6) AS m, sign(p_size - 25)::DOUBLE AS n FROM part""")
def fx_math(t):
    return _formulas(t.part, ["p_partkey"], {
        "a": "abs(p_size - 25)", "b": "sqrt(p_size)", "c": "cbrt(p_size)", "d": "ln(p_size)", "e": "log(p_size)",
        "f": "log2(p_size)", "g": "log10(p_size)", "h": "exp(p_size / 50)", "i": "floor(p_retailprice / 3)",
        "j": "ceil(p_retailprice / 3)", "k": "pow(p_size, 0.5)", "l": "mod(p_size, 4)", "m": "pi() * p_size",
        "n": "sign(p_size - 25)"})


@query("fx_trig", """
    SELECT p_partkey, ROUND(sin(p_size), 6) AS a, ROUND(cos(p_size), 6) AS b, ROUND(tan(p_size / 50), 6) AS c, ROUND(asin(p_size / 51), 6) AS d,
      ROUND(acos(p_size / 51), 6) AS e, ROUND(atan(p_size), 6) AS f FROM part""")
def fx_trig(t):
    return _formulas(t.part, ["p_partkey"], {"a": "sin(p_size)", "b": "cos(p_size)", "c": "tan(p_size / 50)",
                                             "d": "asin(p_size / 51)", "e": "acos(p_size / 51)", "f": "atan(p_size)"})


@query("fx_string", """
    SELECT p_partkey, upper(p_name) AS a, lower(p_type) AS b, length(p_name) AS c, concat(p_name, NULLIF(p_brand, 'Brand#1'), '!') AS d,
      substr(p_name, 2, 3) AS e, substring(p_name, 0, 2) AS f, replace(p_name, 'rod', 'ROD') AS g, trim(concat('  ', p_name, ' ')) AS h, len(p_brand) AS i FROM part""")
def fx_string(t):
    out = _formulas(t.part, ["p_partkey"], {
        "a": "upper(p_name)", "b": "lower(p_type)", "c": "length(p_name)", "d": "concat(p_name, nullif(p_brand, 'Brand#1'), '!')",
        "e": "substr(p_name, 2, 3)", "f": "substring(p_name, 0, 2)", "g": "replace(p_name, 'rod', 'ROD')",
        "h": "trim(concat('  ', p_name, ' '))", "i": "len(p_brand)"})
    return out.withColumns({n: F.col(n).cast("bigint") for n in ("c", "i")})


@query("fx_cast", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, TRY_CAST(p_name AS INTEGER) AS b, CAST(p_partkey AS VARCHAR) AS c FROM part""")
def fx_cast(t):
    return _formulas(t.part, ["p_partkey"], {"a": "cast(p_size as double)", "b": "try_cast(p_name as int)",
                                             "c": "cast(p_partkey as varchar)"})


@query("fx_to_numeric", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS n, TRY_CAST(p_brand AS DOUBLE) AS bad FROM part")
def fx_to_numeric(t):
    return t.part.select("p_partkey", F.split("p_brand", "#")[1].try_cast("double").alias("n"),
                         F.col("p_brand").try_cast("double").alias("bad"))


@query("fx_to_datetime", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def fx_to_datetime(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(
        F.date_format("o_orderdate", "d MMM yyyy"))
    return t.orders.select("o_orderkey", parse_mixed(text).cast("date").alias("day"))


@query("fx_date", """
    SELECT event_id, CAST(ts AS DATE) AS d, CAST(date_trunc('week', ts) AS DATE) + 6 AS w, CAST(date_trunc('month', ts) AS DATE) AS m,
      CAST(date_trunc('quarter', ts) AS DATE) AS q, CAST(date_trunc('year', ts) AS DATE) AS y, date_trunc('hour', ts) AS h, strftime(ts, '%b %Y') AS label FROM events""")
def fx_date(t):
    ts = F.col("ts")
    return t.events.select("event_id", *[period_start(ts, p.upper()).alias(p) for p in "dwmqyh"],
                           F.date_format("ts", "MMM yyyy").alias("label"))


@query("fx_case", "SELECT p_partkey, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS title FROM part")
def fx_case(t):
    return t.part.select("p_partkey", F.initcap("p_name").alias("title"))


@query("fx_regex", r"SELECT doc_id, md5(regexp_replace(text, '(\w)\1', '\1', 'g')) AS digest FROM documents WHERE FALSE UNION ALL SELECT doc_id, md5(regexp_replace(text, '([A-Z])([a-z]+)', '\2\1', 'g')) FROM documents")
def fx_regex(t):
    return t.documents.select("doc_id", F.md5(replace_pattern(F.col("text"), "([A-Z])([a-z]+)", r"\2\1")).alias("digest"))


@query("fx_format", """
    WITH c AS (SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
    t AS (SELECT *, (cents + 5000) // 10000 AS k, (cents + 500000) // 1000000 AS m FROM c)
    SELECT o_orderkey, '$' || CASE
        WHEN cents >= 100000000 THEN regexp_replace((m // 100) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0'), '[.]0+$', '') || 'M'
        WHEN cents >= 100000 THEN regexp_replace((k // 10) || '.' || (k % 10), '[.]0+$', '') || 'K'
        ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS text FROM t""")
def fx_format(t):
    return t.orders.select("o_orderkey", short_column(F.col("o_totalprice"), "price").alias("text"))
