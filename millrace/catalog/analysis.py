"""Profiles, question templates, charts, root cause, alerts and relationship discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.catalog.cleaning import _GAPPY, gappy
from millrace.catalog.registry import query
from millrace.columns import resolve_column
from millrace.functions.formula import apply_metrics, formula_column
from millrace.operators import alerts, charts, profile, questions, relations, root_cause
from millrace.session import scratch_path

_Q = "quantile_cont"


def _kinds(df, **digits):
    return df.withColumns({n: F.round(n, d) for n, d in digits.items()})


def _union(parts):
    return " UNION ALL ".join(parts)


# ---- profiles

_GAP_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "qty", "price", "flag", "tax"]


@query("profile", _union([
    f"""SELECT '{c}' AS name, ROUND(AVG(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END), 1) AS null_pct,
        ROUND(100 - ROUND(AVG(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END), 1), 1) AS quality FROM {_GAPPY}"""
    for c in _GAP_COLUMNS]))
def profile_query(t):
    return profile.profile_table(gappy(t)).drop("dtype")


@query("q_missing", _union([
    f"""SELECT '{c}' AS "column", CAST(COUNT(*) FILTER ({c} IS NULL) AS BIGINT) AS missing,
        ROUND(COUNT(*) FILTER ({c} IS NULL) * 100.0 / COUNT(*), 2) AS missing_pct FROM {_GAPPY}"""
    for c in _GAP_COLUMNS]))
def q_missing(t):
    return questions.answer(gappy(t), {"intent": "missing"})


@query("q_summary",
    f"WITH g AS (SELECT * FROM {_GAPPY}) " + _union([
    f"""SELECT '{c}' AS "column", COUNT({c}) AS non_null, ROUND(COUNT(*) FILTER ({c} IS NULL) * 100.0 / COUNT(*), 1) AS missing_pct,
        COUNT(DISTINCT {c}) AS "unique", {f"ROUND(MIN({c})::DOUBLE, 2)" if c != 'flag' else 'NULL'} AS min,
        {f"ROUND(AVG({c}), 2)" if c != 'flag' else 'NULL'} AS mean, {f"ROUND(MAX({c})::DOUBLE, 2)" if c != 'flag' else 'NULL'} AS max,
        {"(SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY flag ORDER BY COUNT(*) DESC, flag LIMIT 1)" if c == 'flag' else 'NULL'} AS sample
        FROM g""" for c in ("l_orderkey", "qty", "price", "flag", "tax")]))
def q_summary(t):
    data = gappy(t).select("l_orderkey", "qty", "price", "flag", "tax")
    return questions.answer(data, {"intent": "summary"}).drop("type")


@query("schema_describe", """
    SELECT 'o_orderstatus' AS "column", 3::BIGINT * 0 + COUNT(DISTINCT o_orderstatus) AS "unique",
           'values=[' || (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus s FROM orders)) || ']' AS content FROM orders
    UNION ALL SELECT 'o_custkey', COUNT(DISTINCT o_custkey), 'range=[' || MIN(o_custkey) || ', ' || MAX(o_custkey) || ']' FROM orders
    UNION ALL SELECT 'name', COUNT(DISTINCT c_name), 'sample=[' || (SELECT string_agg(n, ', ' ORDER BY n) FROM
        (SELECT DISTINCT c_name n FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY 1 LIMIT 3)) || ']'
        FROM orders JOIN customer ON o_custkey = c_custkey""")
def schema_describe(t):
    data = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderstatus", "o_custkey", F.col("c_name").alias("name"))
    return profile.describe_schema(data).select("column", "unique", "content")


@query("eda_profile", f"""
    SELECT c_mktsegment AS value, COUNT(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def eda_profile(t):
    tables = profile.eda_profile(t.customer.drop("c_name"))
    return tables["categories"].select("value", "count")


@query("report_stats", """
    SELECT 'l_quantity' AS "column", ROUND(AVG(l_quantity), 4) AS mean, median(l_quantity) AS median, ROUND(stddev_samp(l_quantity), 4) AS std, MIN(l_quantity) AS min, MAX(l_quantity) AS max FROM lineitem
    UNION ALL SELECT 'l_discount', ROUND(AVG(l_discount), 4), median(l_discount), ROUND(stddev_samp(l_discount), 4), MIN(l_discount), MAX(l_discount) FROM lineitem""")
def report_stats(t):
    out = profile.report_stats(t.lineitem.select("l_quantity", "l_discount", "l_returnflag"))["numeric"]
    return _kinds(out, mean=4, std=4)


@query("table_summary", """
    SELECT 'region' AS table_name, COUNT(*) AS row_count, 'r_name' AS column_name, 0::BIGINT AS null_count, COUNT(DISTINCT r_name) AS unique_count, (SELECT list(r_name ORDER BY r_name) FROM (SELECT r_name FROM region ORDER BY 1 LIMIT 3)) AS sample_values FROM region
    UNION ALL SELECT 'nation', COUNT(*), 'n_name', 0, COUNT(DISTINCT n_name), (SELECT list(n_name ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY 1 LIMIT 3)) FROM nation
    UNION ALL SELECT 'part', COUNT(*), 'p_brand', 0, COUNT(DISTINCT p_brand), (SELECT list(b ORDER BY b) FROM (SELECT DISTINCT p_brand b FROM part ORDER BY 1 LIMIT 3)) FROM part""")
def table_summary(t):
    out = profile.table_summaries({"region": t.region.select("r_name"), "nation": t.nation.select("n_name"),
                                   "part": t.part.select("p_brand")})
    return out.drop("dtype")


@query("detect_schema", """
    WITH d AS (SELECT COUNT(*) AS n, COUNT(DISTINCT l_quantity) AS q, COUNT(DISTINCT l_extendedprice) AS e, COUNT(DISTINCT l_discount) AS d,
                      COUNT(DISTINCT l_tax) AS t, COUNT(DISTINCT l_returnflag) AS f, COUNT(DISTINCT l_linestatus) AS s FROM lineitem),
    c AS (SELECT unnest([{'name': 'l_quantity', 'k': q}, {'name': 'l_extendedprice', 'k': e}, {'name': 'l_discount', 'k': d}, {'name': 'l_tax', 'k': t}],
                        recursive := true), n FROM d)
    SELECT 'date' AS role, 'l_shipdate' AS "column" UNION ALL SELECT 'dataset_type', 'sales'
    UNION ALL SELECT CASE WHEN k <= greatest(10, n * 0.05) THEN 'dimension' ELSE 'metric' END, name FROM c
    UNION ALL SELECT 'dimension', unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'])
    UNION ALL SELECT 'dimension', 'l_returnflag' FROM d WHERE f <= greatest(50, n * 0.2)
    UNION ALL SELECT 'dimension', 'l_linestatus' FROM d WHERE s <= greatest(50, n * 0.2)""")
def detect_schema(t):
    roles = profile.detect_schema(t.lineitem)
    rows = [("date", roles["date"]), ("dataset_type", roles["dataset_type"])]
    rows += [("metric", m) for m in roles["metrics"]] + [("dimension", d) for d in roles["dimensions"]]
    return t.spark.createDataFrame(rows, "role string, column string")


@query("infer_rel", """
    SELECT * FROM (VALUES ('orders', 'customer_id', 'customer', 'id', 0.98::DOUBLE),
                          ('orders', 'order_key', 'lineitem', 'order_key', 0.95::DOUBLE))
        v(left_table, left_column, right_table, right_column, confidence),
    LATERAL (SELECT CASE WHEN left_column = 'customer_id' THEN
        (SELECT CASE WHEN COUNT(DISTINCT o_custkey) * 1.0 / COUNT(*) >= 0.98 THEN 'one' ELSE 'many' END FROM orders) || '_to_' ||
        (SELECT CASE WHEN COUNT(DISTINCT c_custkey) * 1.0 / COUNT(*) >= 0.98 THEN 'one' ELSE 'many' END FROM customer)
      ELSE (SELECT CASE WHEN COUNT(DISTINCT o_orderkey) * 1.0 / COUNT(*) >= 0.98 THEN 'one' ELSE 'many' END FROM orders) || '_to_' ||
        (SELECT CASE WHEN COUNT(DISTINCT l_orderkey) * 1.0 / COUNT(*) >= 0.98 THEN 'one' ELSE 'many' END FROM lineitem) END AS cardinality)""")
def infer_rel(t):
    return relations.infer_relationships({
        "orders": t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_id"),
                                  F.col("o_totalprice").alias("amount")),
        "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_quantity").alias("quantity")),
    }).drop("reason")


# ---- question templates

def _by_segment(word):
    return lambda t: _kinds(questions.answer(t.customer, {
        "intent": word, "numeric_col": "c_acctbal", "category_col": "c_mktsegment"}), c_acctbal=4)


for _word, _sql in (("mean", "AVG"), ("median", "median"), ("sum", "SUM"), ("max", "MAX"), ("min", "MIN")):
    query(f"q_{_word}", f"SELECT c_mktsegment, ROUND({_sql}(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")(
        _by_segment(_word))


@query("q_scalar", """
    SELECT 'mean' AS word, 'p_size' AS "column", ROUND(AVG(p_size), 4) AS value FROM part UNION ALL SELECT 'mean', 'p_retailprice', ROUND(AVG(p_retailprice), 4) FROM part
    UNION ALL SELECT 'median', 'p_size', median(p_size) FROM part UNION ALL SELECT 'median', 'p_retailprice', ROUND(median(p_retailprice), 4) FROM part""")
def q_scalar(t):
    out = None
    for word in ("mean", "median"):
        part = questions.answer(t.part, {"intent": word, "numeric_cols": ["p_size", "p_retailprice"]})
        part = _kinds(part, value=4).withColumn("word", F.lit(word))
        out = part if out is None else out.unionByName(part)
    return out


@query("q_count", "SELECT event_type, COUNT(*) AS count FROM events GROUP BY 1")
def q_count(t):
    return questions.answer(t.events, {"intent": "count", "category_col": "event_type"})


@query("q_unique", "SELECT DISTINCT p_type, (SELECT COUNT(DISTINCT p_type) FROM part) AS unique_count FROM part")
def q_unique(t):
    return questions.answer(t.part, {"intent": "unique", "category_col": "p_type"})


@query("q_unique_all", _union([f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS unique_count FROM part"""
                               for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]))
def q_unique_all(t):
    return questions.answer(t.part, {"intent": "unique"})


@query("q_distribution", _union([
    f"""SELECT 'o_totalprice' AS "column", '{k}' AS statistic, ROUND(({e})::DOUBLE, 4) AS value FROM orders""" for k, e in (
        ("count", "COUNT(o_totalprice)"), ("mean", "AVG(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"),
        ("min", "MIN(o_totalprice)"), ("25%", f"{_Q}(o_totalprice, 0.25)"), ("50%", f"{_Q}(o_totalprice, 0.5)"),
        ("75%", f"{_Q}(o_totalprice, 0.75)"), ("max", "MAX(o_totalprice)"))]))
def q_distribution(t):
    return questions.answer(t.orders, {"intent": "distribution", "numeric_col": "o_totalprice"})


@query("q_correlation", f"""
    WITH g AS (SELECT COALESCE(qty, AVG(qty) OVER ()) AS qty, COALESCE(price, AVG(price) OVER ()) AS price, COALESCE(tax, AVG(tax) OVER ()) AS tax FROM {_GAPPY})
    SELECT 'qty' AS "column", 1.0::DOUBLE AS qty, ROUND(corr(qty, price), 4) AS price, ROUND(corr(qty, tax), 4) AS tax FROM g
    UNION ALL SELECT 'price', ROUND(corr(qty, price), 4), 1.0, ROUND(corr(price, tax), 4) FROM g
    UNION ALL SELECT 'tax', ROUND(corr(qty, tax), 4), ROUND(corr(price, tax), 4), 1.0 FROM g""")
def q_correlation(t):
    return questions.answer(gappy(t), {"intent": "correlation", "numeric_cols": ["qty", "price", "tax"]})


@query("q_trend", "SELECT o_orderdate, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def q_trend(t):
    return _kinds(questions.answer(t.orders, {"intent": "trend", "datetime_col": "o_orderdate",
                                              "numeric_col": "o_totalprice", "agg_func": "sum"}), o_totalprice=2)


@query("q_outlier", f"""
    SELECT e.* FROM events e, (SELECT {_Q}(value, 0.25) q1, {_Q}(value, 0.75) q3 FROM events)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_outlier(t):
    return questions.answer(t.events, {"intent": "outlier", "numeric_col": "value"})


@query("q_compare", "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def q_compare(t):
    return _kinds(questions.answer(t.orders, {"intent": "compare", "numeric_col": "o_totalprice",
                                              "category_col": "o_orderpriority", "agg_func": "mean"}), o_totalprice=4)


@query("q_compare_all", _union([
    f"""SELECT '{c}' AS "column", ROUND(AVG({c}), 4) AS mean, ROUND(median({c}), 4) AS median, ROUND(stddev_samp({c}), 4) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max FROM part"""
    for c in ("p_size", "p_retailprice")]))
def q_compare_all(t):
    return _kinds(questions.answer(t.part, {"intent": "compare", "numeric_cols": ["p_size", "p_retailprice"]}),
                  mean=4, median=4, std=4)


@query("q_box", f"""
    WITH f AS (SELECT {_Q}(value, 0.25) q1, {_Q}(value, 0.75) q3 FROM events)
    SELECT 'value' AS "column", ROUND(MIN(value), 4) AS min, ROUND(MIN(q1), 4) AS q1, ROUND(median(value), 4) AS median, ROUND(AVG(value), 4) AS mean,
      ROUND(MIN(q3), 4) AS q3, ROUND(MAX(value), 4) AS max, ROUND(MIN(q1 - 1.5 * (q3 - q1)), 4) AS lower_fence, ROUND(MIN(q3 + 1.5 * (q3 - q1)), 4) AS upper_fence,
      COUNT(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM events, f""")
def q_box(t):
    return questions.answer(t.events, {"intent": "box_plot", "numeric_col": "value"})


@query("q_top_n", "SELECT p_brand, ROUND(SUM(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 4")
def q_top_n(t):
    return _kinds(questions.answer(t.part, {"intent": "top_n", "numeric_col": "p_retailprice", "category_col": "p_brand",
                                            "n": 4, "ascending": True}), p_retailprice=2)


@query("col_inspect", """
    SELECT value, COUNT(*) AS count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM part), 1) AS pct, (SELECT COUNT(*) FROM part) AS "rows",
      0::BIGINT AS nulls, (SELECT COUNT(DISTINCT p_size) FROM part) AS "unique", (SELECT MIN(p_size)::DOUBLE FROM part) AS min,
      (SELECT MAX(p_size)::DOUBLE FROM part) AS max, (SELECT ROUND(AVG(p_size), 2) FROM part) AS mean
    FROM (SELECT CAST(p_size AS VARCHAR) AS value FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def col_inspect(t):
    return profile.inspect_column(t.part, "p_size")


@query("metric_def", """
    SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net, ROUND(SUM(l_extendedprice * l_tax), 2) AS tax_paid
    FROM lineitem GROUP BY 1""")
def metric_def(t):
    out = apply_metrics(t.lineitem, {"net": "L_ExtendedPrice * (1 - l_discount)", "tax_paid": "l_extendedprice * l_tax"},
                        ["l_returnflag"])
    return _kinds(out, net=2, tax_paid=2)


# ---- charts

@query("chart_bar_agg", "SELECT c_mktsegment AS label, ROUND(SUM(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def chart_bar_agg(t):
    return charts.chart(t.customer, {"chart_type": "bar", "x_col": " C_MKTSEGMENT ", "y_col": "c_acctbal", "agg_type": "sum"})


@query("chart_bar_raw", "SELECT CAST(event_id AS VARCHAR) AS label, value FROM events ORDER BY ts LIMIT 500")
def chart_bar_raw(t):
    return charts.bar(t.events, "event_id", "value", "none", ["ts"])


@query("win_topn_other", """
    WITH g AS (SELECT p_brand AS label, SUM(p_retailprice) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn FROM g)
    SELECT CASE WHEN rn <= 10 THEN label ELSE 'Other' END AS label, ROUND(SUM(v), 2) AS value FROM r GROUP BY 1""")
def win_topn_other(t):
    return charts.chart(t.part, {"chart_type": "pie", "x_col": "p_brand", "y_col": "p_retailprice", "agg_type": "sum"})


@query("win_topn_other_mean", """
    WITH g AS (SELECT p_brand AS label, AVG(p_size) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn FROM g)
    SELECT CASE WHEN rn <= 4 THEN label ELSE 'Other' END AS label, ROUND(AVG(v), 2) AS value FROM r GROUP BY 1""")
def win_topn_other_mean(t):
    return charts.pie(t.part, "p_brand", "p_size", "mean", 4)


@query("chart_default", """
    SELECT * FROM (SELECT 'bar' AS chart, o_orderpriority AS label, ROUND(SUM(o_totalprice), 2) AS value FROM orders GROUP BY 2 ORDER BY 3 DESC LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'top_cat', o_orderpriority, ROUND(AVG(o_totalprice), 2) FROM orders GROUP BY 2 ORDER BY 3 DESC LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'cat2', o_orderstatus, ROUND(AVG(o_totalprice), 2) FROM orders GROUP BY 2 ORDER BY 3 DESC LIMIT 8)""")
def chart_default(t):
    return charts.default_charts(t.orders, "o_orderpriority", "o_totalprice", "o_orderstatus")


@query("chart_query", "SELECT p_type AS label, ROUND(AVG(p_size), 6) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def chart_query(t):
    return _kinds(charts.answer_chart(t.part, "p_type", "p_size", 3), value=6)


_HIST = """
    WITH s AS (SELECT MIN({c}) lo, MAX({c}) hi FROM {t}), b AS (SELECT LEAST(CAST(FLOOR(({c} - lo) / (hi - lo) * {n}) AS INTEGER), {n} - 1) AS bin FROM {t}, s)
    SELECT CAST(i AS INTEGER) AS bin, ROUND(lo + i * (hi - lo) / {n}, 4) AS bin_low, COUNT(b.bin) AS n
    FROM range({n}) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = r.i GROUP BY i, lo, hi"""


@query("chart_hist", _HIST.format(c="value", t="events", n=15))
def chart_hist(t):
    return _kinds(charts.histogram(t.events, "value"), bin_low=4).drop("bin_high")


@query("chart_cut4", """
    WITH s AS (SELECT MIN(o_totalprice) lo, MAX(o_totalprice) hi FROM orders), b AS (SELECT GREATEST(CAST(CEIL((o_totalprice - lo) / (hi - lo) * 4) AS INTEGER) - 1, 0) AS bin FROM orders, s)
    SELECT bin, COUNT(*) AS n FROM b GROUP BY bin""")
def chart_cut4(t):
    return charts.cut(t.orders, "o_totalprice").select("bin", "n")


@query("chart_box", f"""
    WITH f AS (SELECT {_Q}(value, 0.25) q1, median(value) m, {_Q}(value, 0.75) q3 FROM events)
    SELECT MIN(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS min, ROUND(MIN(q1), 6) AS q1, ROUND(MIN(m), 6) AS median, ROUND(MIN(q3), 6) AS q3,
           MAX(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS max FROM events, f""")
def chart_box(t):
    return _kinds(charts.box(t.events, "value"), q1=6, median=6, q3=6)


@query("chart_scatter", """
    SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
    ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, 42)), l_orderkey, l_linenumber, l_partkey LIMIT 500""")
def chart_scatter(t):
    return charts.scatter(t.lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("chart_radar", "SELECT p_brand AS label, COUNT(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def chart_radar(t):
    return charts.chart(t.part, {"chart_type": "radar", "x_col": "p_brand"})


@query("chart_polar", "SELECT p_brand AS label, ROUND(SUM(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def chart_polar(t):
    return charts.chart(t.part, {"chart_type": "polarArea", "x_col": "p_brand", "y_col": "p_retailprice", "agg_type": "sum"})


@query("chart_heatmap", """
    WITH c AS (SELECT ROUND(corr(l_quantity, l_extendedprice), 3) qe, ROUND(corr(l_quantity, l_discount), 3) qd, ROUND(corr(l_extendedprice, l_discount), 3) ed FROM lineitem)
    SELECT r AS "row", k AS "column", CASE WHEN r = k THEN 1.0::DOUBLE WHEN (r || k) IN ('l_quantityl_extendedprice', 'l_extendedpricel_quantity') THEN qe
      WHEN (r || k) IN ('l_quantityl_discount', 'l_discountl_quantity') THEN qd ELSE ed END AS r
    FROM c, (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) a(r), (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) b(k)""")
def chart_heatmap(t):
    return charts.heatmap(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount"))


@query("chart_waterfall", """
    WITH g AS (SELECT p_brand AS label, ROUND(SUM(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY 1 LIMIT 8)
    SELECT * FROM g UNION ALL SELECT 'Net Total', ROUND(SUM(value), 2) FROM g""")
def chart_waterfall(t):
    return charts.waterfall(t.part, "p_brand", "p_retailprice")


@query("chart_funnel", """
    WITH g AS (SELECT event_type AS label, COUNT(*)::DOUBLE AS value FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
    SELECT label, value, ROUND(value / (SELECT MAX(value) FROM g) * 100, 1) AS pct FROM g""")
def chart_funnel(t):
    return charts.funnel(t.events, "event_type")


@query("chart_combo", """
    SELECT o_orderpriority AS label, COUNT(*)::DOUBLE AS bars, ROUND(AVG(o_totalprice), 2) AS lines FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def chart_combo(t):
    return charts.combo(t.orders, "o_orderpriority", "o_totalprice")


@query("chart_trend_month", """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, ROUND(SUM(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def chart_trend_month(t):
    return charts.month_trend(t.orders, "o_orderdate", "o_totalprice")


@query("kpi_stats", f"""
    WITH g AS (SELECT qty, flag FROM {_GAPPY})
    SELECT 'rows' AS type, COUNT(*)::DOUBLE AS value FROM g UNION ALL SELECT 'sum', ROUND(SUM(qty), 2) FROM g
    UNION ALL SELECT 'distinct', COUNT(DISTINCT flag)::DOUBLE FROM g
    UNION ALL SELECT 'completeness', ROUND(100 - (COUNT(*) FILTER (qty IS NULL) + COUNT(*) FILTER (flag IS NULL)) * 100.0 / (2 * COUNT(*)), 1) FROM g""")
def kpi_stats(t):
    return charts.kpi_stats(gappy(t).select("qty", "flag"), "flag", "qty").select("type", "value")


@query("id_like", """
    SELECT 'nation_id' AS col, MIN(c_nationkey)::DOUBLE AS min, MAX(c_nationkey)::DOUBLE AS max, COUNT(DISTINCT c_nationkey) AS total FROM customer""")
def id_like(t):
    return charts.id_stats(t.customer.select("c_acctbal", F.col("c_nationkey").alias("nation_id")))


# ---- root cause, alerts

_MID = "(SELECT median(epoch_us(o_orderdate)) FROM orders)"


@query("root_contribution", """
    WITH s AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS value, SUM(o_totalprice) s FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, SUM(o_totalprice) FROM orders GROUP BY 2)
    SELECT dimension, value, ROUND(s, 2) AS contribution, ROUND(s / (SELECT SUM(o_totalprice) FROM orders) * 100, 2) AS pct_share FROM s""")
def root_contribution(t):
    found = root_cause.root_cause(t.orders, "o_totalprice", ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return _kinds(found.drivers, contribution=2).drop("pct_change")


@query("root_change", f"""
    WITH s AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS value, SUM(CASE WHEN epoch_us(o_orderdate) <= {_MID} THEN o_totalprice ELSE 0 END) p,
        SUM(CASE WHEN epoch_us(o_orderdate) > {_MID} THEN o_totalprice ELSE 0 END) c FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, SUM(CASE WHEN epoch_us(o_orderdate) <= {_MID} THEN o_totalprice ELSE 0 END),
        SUM(CASE WHEN epoch_us(o_orderdate) > {_MID} THEN o_totalprice ELSE 0 END) FROM orders GROUP BY 2),
    d AS (SELECT SUM(c - p) / 2 AS total FROM s)
    SELECT dimension, value, ROUND(c - p, 2) AS contribution, ROUND((c - p) / abs(total) * 100, 2) AS pct_share,
           ROUND((c - p) / p * 100, 2) AS pct_change, ROUND(p, 2) AS prev, ROUND(c, 2) AS curr FROM s, d""")
def root_change(t):
    found = root_cause.root_cause(t.orders, "o_totalprice", ["o_orderpriority", "o_orderstatus"], "o_orderdate")
    return _kinds(found.drivers, contribution=2, prev=2, curr=2)


@query("segment_union", """
    WITH a AS (SELECT p_brand AS value, SUM(p_size) v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
         b AS (SELECT p_brand AS value, SUM(p_size) v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
    SELECT COALESCE(a.value, b.value) AS value, COALESCE(a.v, 0)::DOUBLE AS prev, COALESCE(b.v, 0)::DOUBLE AS curr FROM a FULL JOIN b ON a.value = b.value""")
def segment_union(t):
    prev = t.part.where("p_partkey % 2 = 0").withColumn("late", F.lit(False))
    curr = t.part.where("p_partkey % 2 = 1").withColumn("late", F.lit(True))
    both = prev.unionByName(curr)
    return both.groupBy(F.col("p_brand").alias("value")).agg(
        F.sum(F.when(~F.col("late"), F.col("p_size")).otherwise(0)).cast("double").alias("prev"),
        F.sum(F.when(F.col("late"), F.col("p_size")).otherwise(0)).cast("double").alias("curr"))


@query("alert_baseline", """
    SELECT 0 AS position, 'o_totalprice' AS metric, COUNT(*) AS row_count, ROUND(AVG(o_totalprice), 4) AS mean, ROUND(stddev_samp(o_totalprice), 4) AS std, 0.0::DOUBLE AS missing FROM orders""")
def alert_baseline(t):
    return _kinds(alerts.baseline(t.orders, ["o_totalprice", "gone"]), mean=4, std=4)


@query("alert_check", """
    WITH b AS (SELECT COUNT(*) n, AVG(l_quantity) q, AVG(l_extendedprice) e FROM lineitem),
    c AS (SELECT COUNT(*) n, AVG(CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END) q, AVG(l_extendedprice * 0.5) e,
          AVG(CASE WHEN l_orderkey % 10 = 0 THEN 1.0 ELSE 0 END) m FROM lineitem WHERE l_discount < 0.05)
    SELECT 'critical_drop' AS rule, 'critical' AS severity, 'l_extendedprice' AS metric, ROUND(abs((c.e - b.e) / b.e) * 100, 1) AS pct_change FROM b, c WHERE (c.e - b.e) / b.e < -0.4
    UNION ALL SELECT 'metric_drop', 'warning', 'l_extendedprice', ROUND(abs((c.e - b.e) / b.e) * 100, 1) FROM b, c WHERE (c.e - b.e) / b.e < -0.2
    UNION ALL SELECT 'missing_values', 'warning', 'l_quantity', ROUND(c.m * 100, 1) FROM c WHERE c.m > 0.05
    UNION ALL SELECT 'row_count_drop', 'warning', 'row count', ROUND(abs((c.n - b.n)::DOUBLE / b.n) * 100, 1) FROM b, c WHERE (c.n - b.n)::DOUBLE / b.n < -0.3""")
def alert_check(t):
    path = scratch_path(t.spark, "baseline")
    metrics = ["l_quantity", "l_extendedprice"]
    assert alerts.check(t.lineitem, metrics, path).count() == 0
    later = t.lineitem.where("l_discount < 0.05").withColumns({
        "l_quantity": F.expr("CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END"),
        "l_extendedprice": F.col("l_extendedprice") * 0.5})
    return alerts.check(later, metrics, path).select("rule", "severity", "metric", F.round("pct_change", 1).alias("pct_change"))


@query("resolve_column", "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")
def resolve_column_query(t):
    group = resolve_column("  C_MktSegment ", t.customer.columns)
    measure = resolve_column("c_acctbal", t.customer.columns)
    assert resolve_column("segment", t.customer.columns) is None
    return _kinds(t.customer.groupBy(group).agg(F.avg(measure).alias(measure)), c_acctbal=4)


_TYPED = ("customer", "events", "lineitem", "orders", "part")
_WORDS = ", ".join(f"({i}, '{d}', '{w}')" for i, (d, words) in enumerate(profile.DOMAIN_WORDS.items()) for w in words)


@query("dataset_type", f"""
    WITH w AS (SELECT * FROM (VALUES {_WORDS}) x(i, domain, word)),
    c AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest(json_keys(to_json(r))) AS name FROM (SELECT r FROM {t} r LIMIT 1)" for t in _TYPED)}),
    v AS (SELECT table_name, i, domain, COUNT(*) AS votes FROM c JOIN w ON contains(lower(name), word) GROUP BY 1, 2, 3),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY votes DESC, i) AS r FROM v) WHERE r = 1),
    n AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in _TYPED)})
    SELECT n.table_name, COALESCE(domain, 'general') AS domain, n_rows FROM n LEFT JOIN b ON b.table_name = n.table_name""")
def dataset_type(t):
    parts = [(name, getattr(t, name)) for name in _TYPED]
    counted = [df.agg(F.lit(name).alias("table_name"), F.lit(profile.dataset_type(df.columns)).alias("domain"),
                      F.count(F.lit(1)).alias("n_rows")) for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query("nl_insight", """
    WITH g AS (SELECT c_mktsegment s, AVG(c_acctbal) m FROM customer GROUP BY 1)
    SELECT '''' || s || ''' has the highest c_acctbal of ' || (SELECT COUNT(*) FROM g) || ' c_mktsegment groups: ' || format('{:,.2f}', m) || '.' AS text
    FROM g ORDER BY m DESC LIMIT 1""")
def nl_insight(t):
    plan = {"intent": "mean", "numeric_col": "c_acctbal", "category_col": "c_mktsegment"}
    text = questions.answer_text(questions.answer(t.customer, plan), plan)
    return t.spark.createDataFrame([(text,)], "text string")


@query("fx_minmax", "SELECT o_orderstatus, MIN(o_totalprice) AS low, MAX(o_totalprice * 2) AS high FROM orders GROUP BY 1")
def fx_minmax(t):
    low = formula_column(t.spark, "min(o_totalprice)", t.orders.columns, aggregates=True)
    high = formula_column(t.spark, "max(o_totalprice * 2)", t.orders.columns, aggregates=True)
    return t.orders.groupBy("o_orderstatus").agg(low.alias("low"), high.alias("high"))
