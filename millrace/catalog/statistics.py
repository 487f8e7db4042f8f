"""Correlation scans, association and difference tests, insights and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import hypothesis, series
from millrace.operators.forecast import forecast_table, run_forecast
from millrace.operators.insights import findings, insight_report, insight_table, run_insights
from millrace.operators.insights.facts import Facts

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "gross"]
_LINES = "(SELECT *, l_extendedprice * (1 - l_discount) AS gross FROM lineitem)"


def _lines(t):
    return t.lineitem.withColumn("gross", F.expr("l_extendedprice * (1 - l_discount)"))


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]


@query("corr_fdr", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, COUNT(*) AS sample_size, ROUND(corr({a}, {b}), 6) AS statistic, "
    f"ROUND(abs(corr({a}, {b})), 6) AS effect_size FROM {_LINES}" for a, b in _PAIRS))
def corr_fdr(t):
    lines = _lines(t)
    tests = hypothesis.numeric_correlations(lines, _NUM)
    out = hypothesis.pair_table(lines, tests)
    return out.select("column_a", "column_b", "sample_size", F.round("statistic", 6).alias("statistic"),
                      F.round("effect_size", 6).alias("effect_size"))


def _tail(density: str) -> str:
    """Twice the area under a density of x from x0 on, by Simpson's rule."""
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = density.replace("{x}", "(x0 + i * 0.01)")
    return f"least(1.0, 2 * (SELECT SUM({weight} * {inner}) FROM range(4001) r(i)) * 0.01 / 3)"


_T_TAIL = _tail("exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + {x} * {x} / v, -(v + 1) / 2)")
_NORMAL_TAIL = _tail("exp(-{x} * {x} / 2) / sqrt(2 * pi())")


@query("corr_fdr_significance", f"""
    WITH r AS ({" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r, COUNT(*) AS n FROM {_LINES}" for a, b in _PAIRS)}),
    z AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS x0, (n - 2)::DOUBLE AS v FROM r),
    p AS (SELECT column_a, column_b, {_T_TAIL} AS p_value FROM z),
    k AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, COUNT(*) OVER () AS m FROM p),
    q AS (SELECT *, least(1.0, MIN(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM k)
    SELECT column_a, column_b, ROUND(p_value, 6) AS p_value, ROUND(q_value, 6) AS q_value, q_value <= 0.05 AS significant FROM q""")
def corr_fdr_significance(t):
    lines = _lines(t)
    table = hypothesis.pair_table(lines, hypothesis.numeric_correlations(lines, _NUM))
    return table.select("column_a", "column_b", F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"),
                        "significant")


_P = "(SELECT p_partkey, (p_partkey * 37 % 1000 + 0.5) / 1000 * (p_size / 50.0) AS p FROM part)"


def _p_values(t):
    return t.part.select("p_partkey", F.expr("(p_partkey * 37 % 1000 + 0.5) / 1000 * (p_size / 50.0)").cast("double").alias("p"))


@query("fdr_adjust", f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, COUNT(*) OVER () AS m FROM {_P})
    SELECT p_partkey, ROUND(LEAST(MIN(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q_value FROM r""")
def fdr_adjust(t):
    out = hypothesis.adjust_p_table(_p_values(t), "p")
    return out.select("p_partkey", F.round("q_value", 9).alias("q_value"))


@query("fdr_bonferroni", f"SELECT p_partkey, ROUND(LEAST(p * (SELECT COUNT(*) FROM part), 1), 9) AS q_value FROM {_P}")
def fdr_bonferroni(t):
    out = hypothesis.adjust_p_table(_p_values(t), "p", "bonferroni")
    return out.select("p_partkey", F.round("q_value", 9).alias("q_value"))


@query("fdr_by", f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, COUNT(*) OVER () AS m FROM {_P}),
    c AS (SELECT SUM(1.0::DOUBLE / i) AS c FROM range(1, (SELECT COUNT(*) + 1 FROM part)) x(i))
    SELECT p_partkey, ROUND(LEAST(MIN(p * m * c / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q_value FROM r, c""")
def fdr_by(t):
    out = hypothesis.adjust_p_table(_p_values(t), "p", "fdr_by")
    return out.select("p_partkey", F.round("q_value", 8).alias("q_value"))


def _chi(a, b, table):
    return f"""
      (SELECT SUM((n - e) * (n - e) / e) AS chi, SUM(n) AS total, (MAX(nr) - 1) * (MAX(nc) - 1) AS dof, LEAST(MAX(nr), MAX(nc)) - 1 AS k FROM (
        SELECT COALESCE(x.n, 0)::DOUBLE AS n, r.n * c.n * 1.0::DOUBLE / (SELECT COUNT(*) FROM {table}) AS e,
          (SELECT COUNT(DISTINCT {a}) FROM {table}) AS nr, (SELECT COUNT(DISTINCT {b}) FROM {table}) AS nc
        FROM (SELECT {a} AS a, COUNT(*) n FROM {table} GROUP BY 1) r CROSS JOIN (SELECT {b} AS b, COUNT(*) n FROM {table} GROUP BY 1) c
        LEFT JOIN (SELECT {a} AS a, {b} AS b, COUNT(*) n FROM {table} GROUP BY 1, 2) x ON x.a = r.a AND x.b = c.b))"""


_CATS = (("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "shard"), ("o_orderpriority", "shard"))
_CHIS = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, * FROM {_chi(a, b, 'orders_x')}".replace(
    "orders_x", "(SELECT *, o_orderkey % 3 AS shard FROM orders)") for a, b in _CATS)


@query("cat_assoc", f"""
    WITH c AS (SELECT *, chi / 2 AS h FROM ({_CHIS})),
    p AS (SELECT *, exp(-h) * (1 + h + CASE WHEN dof = 8 THEN h * h / 2 + h * h * h / 6 ELSE 0 END) AS p FROM c),
    k AS (SELECT *, row_number() OVER (ORDER BY p) AS place, COUNT(*) OVER () AS m FROM p),
    q AS (SELECT *, least(1.0, MIN(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)
    SELECT column_a, column_b, CAST(total AS BIGINT) AS sample_size, ROUND(chi, 4) AS statistic, ROUND(sqrt(chi / (total * k)), 6) AS effect_size,
           ROUND(p, 6) AS p_value, ROUND(q, 6) AS q_value FROM q""")
def cat_assoc(t):
    data = t.orders.withColumn("shard", F.expr("o_orderkey % 3"))
    tests = hypothesis.categorical_associations(data, ["o_orderstatus", "o_orderpriority", "shard", "o_orderkey"])
    return hypothesis.pair_table(data, tests).select(
        "column_a", "column_b", "sample_size", F.round("statistic", 4).alias("statistic"), F.round("effect_size", 6).alias("effect_size"),
        F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"))


@query("chi_square", f"""
    SELECT 'chi_square' AS test, ROUND(chi, 4) AS statistic, ROUND(sqrt(chi / total / k), 4) AS effect_size FROM {_chi('l_returnflag', 'l_linenumber', 'lineitem')}""")
def chi_square(t):
    found = hypothesis.chi_square(t.lineitem, "l_returnflag", "l_linenumber")
    return hypothesis.result_table(t.lineitem, [found]).select("test", "statistic", "effect_size")


@query("t_test", """
    WITH g AS (SELECT c_mktsegment s, COUNT(*) n, AVG(c_acctbal) m, var_samp(c_acctbal) v FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1),
    a AS (SELECT * FROM g WHERE s = 'BUILDING'), b AS (SELECT * FROM g WHERE s = 'FURNITURE')
    SELECT 't_test' AS test, ROUND((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS statistic,
      ROUND(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS effect_size FROM a, b""")
def t_test(t):
    found = hypothesis.t_test(t.customer, "c_acctbal", "c_mktsegment", groups=["BUILDING", "FURNITURE"])
    return hypothesis.result_table(t.customer, [found]).select("test", "statistic", "effect_size")


@query("mann_whitney", """
    WITH v AS (SELECT o_orderstatus g, ROUND(o_totalprice / 1000) AS x FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT g, x, rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM v)
    SELECT 'mann_whitney' AS test, ROUND((SUM(rk) FILTER (g = 'F') - COUNT(*) FILTER (g = 'F') * (COUNT(*) FILTER (g = 'F') + 1) / 2.0)::DOUBLE, 4) AS statistic FROM r""")
def mann_whitney(t):
    data = t.orders.select("o_orderstatus", F.round(F.col("o_totalprice") / 1000).alias("x"))
    found = hypothesis.mann_whitney(data, "x", "o_orderstatus", groups=["F", "O"])
    return hypothesis.result_table(data, [found]).select("test", "statistic")


@query("anova", """
    WITH v AS (SELECT o_orderpriority g, o_totalprice x FROM orders), s AS (SELECT g, COUNT(*) n, AVG(x) m, var_samp(x) v FROM v GROUP BY g),
    t AS (SELECT AVG(x) gm, COUNT(*) n FROM v)
    SELECT 'anova' AS test, ROUND((SUM(s.n * (m - gm) ** 2) / (COUNT(*) - 1)) / (SUM((s.n - 1) * v) / (MAX(t.n) - COUNT(*))), 4) AS statistic FROM s, t""")
def anova(t):
    found = hypothesis.run_test(t.orders, "anova", "o_totalprice", "o_orderpriority")
    return hypothesis.result_table(t.orders, [found]).select("test", "statistic")


@query("anova_all_levels", """
    WITH v AS (SELECT p_brand g, p_retailprice x FROM part), s AS (SELECT g, COUNT(*) n, AVG(x) m, var_samp(x) v FROM v GROUP BY g HAVING COUNT(*) > 1),
    t AS (SELECT SUM(n * m) / SUM(n) AS gm, SUM(n) AS n FROM s)
    SELECT COUNT(*)::BIGINT AS groups, ROUND((SUM(s.n * (m - gm) ** 2) / (COUNT(*) - 1)) / (SUM((s.n - 1) * v) / (MAX(t.n) - COUNT(*))), 6) AS statistic FROM s, t""")
def anova_all_levels(t):
    found = hypothesis.anova(t.part, "p_retailprice", "p_brand")
    return t.spark.createDataFrame([(found["groups"], round(found["statistic"], 6))], "groups long, statistic double")


@query("hypothesis_p_values", f"""
    WITH c AS (SELECT c_acctbal AS v, c_mktsegment AS g FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')),
    m AS (SELECT g, COUNT(*)::DOUBLE AS n, AVG(v) AS m, var_samp(v) AS s FROM c GROUP BY 1),
    t AS (SELECT (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS stat, pow(a.s / a.n + b.s / b.n, 2)
                 / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) AS v FROM m a, m b WHERE a.g < b.g),
    tp AS (SELECT 't_test' AS test, {_T_TAIL} AS p_value FROM (SELECT abs(stat) AS x0, v FROM t)),
    k AS (SELECT g, v, rank() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM c),
    u AS (SELECT SUM(CASE WHEN g = 'BUILDING' THEN r ELSE 0 END) AS r1, COUNT(*) FILTER (g = 'BUILDING')::DOUBLE AS n1, COUNT(*)::DOUBLE AS n FROM k),
    e AS (SELECT COALESCE(SUM(pow(q, 3) - q), 0) AS ties FROM (SELECT COUNT(*)::DOUBLE AS q FROM c GROUP BY v)),
    w AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, n, ties FROM u, e),
    mp AS (SELECT 'mann_whitney' AS test, {_NORMAL_TAIL} AS p_value FROM (SELECT greatest(0, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
             / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))) AS x0 FROM w)),
    g AS (SELECT COUNT(*)::DOUBLE AS n, AVG(o_totalprice) AS m, var_samp(o_totalprice) AS s FROM orders GROUP BY o_orderpriority),
    h AS (SELECT SUM(n * m) / SUM(n) AS grand, SUM(n) AS n, SUM((n - 1) * s) AS within FROM g),
    f AS (SELECT (SELECT SUM(g.n * pow(g.m - grand, 2)) FROM g) / within * (n - 5) / 4 AS f, n - 5 AS d FROM h),
    ap AS (SELECT 'anova' AS test, pow(1 - x, d / 2) * (1 + d / 2 * x) AS p_value FROM (SELECT 4 * f / (4 * f + d) AS x, d FROM f)),
    o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, COUNT(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
    x AS (SELECT SUM(pow(o.n - l.n * r.n / z.n, 2) / (l.n * r.n / z.n)) / 2 AS h FROM o
          JOIN (SELECT a, SUM(n) AS n FROM o GROUP BY 1) l ON o.a = l.a JOIN (SELECT b, SUM(n) AS n FROM o GROUP BY 1) r ON o.b = r.b,
          (SELECT SUM(n) AS n FROM o) z),
    cp AS (SELECT 'chi_square' AS test, exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) AS p_value FROM x)
    SELECT test, ROUND(p_value, 6) AS p_value, p_value < 0.05 AS significant
    FROM (SELECT * FROM tp UNION ALL SELECT * FROM mp UNION ALL SELECT * FROM ap UNION ALL SELECT * FROM cp)""")
def hypothesis_p_values(t):
    groups = ["BUILDING", "FURNITURE"]
    found = [hypothesis.t_test(t.customer, "c_acctbal", "c_mktsegment", groups=groups),
             hypothesis.mann_whitney(t.customer, "c_acctbal", "c_mktsegment", groups=groups),
             hypothesis.run_test(t.orders, "anova", "o_totalprice", "o_orderpriority"),
             hypothesis.run_test(t.orders, "chi_square", "o_orderstatus", "o_orderpriority")]
    return hypothesis.result_table(t.orders, found).select("test", F.round("p_value", 6).alias("p_value"), "significant")


# ---- insights

_ROLES = {"date": "o_orderdate", "metrics": ["o_totalprice"], "dimensions": ["o_orderpriority", "o_orderstatus"],
          "dataset_type": "sales"}
_EVENT_ROLES = {"date": "ts", "metrics": ["value"], "dimensions": ["event_type"], "dataset_type": "product"}


def _numbers(df, insight, *names):
    """(name, value) of the numbers an insight reports."""
    rows = [(n, round(float(insight.meta[n]), 4)) for n in names]
    return df.sparkSession.createDataFrame(rows, "name string, value double")


def _points(df, insight, digits=2):
    rows = [(label, round(float(v), digits)) for label, v in zip(insight.labels, insight.values)]
    return df.sparkSession.createDataFrame(rows, "label string, value double")


@query("ins_trend", """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, SUM(o_totalprice) v FROM orders GROUP BY 1)
    SELECT 'trend' AS name, ROUND(AVG(c), 4) AS value FROM (SELECT v / lag(v) OVER (ORDER BY day) - 1 AS c FROM d)""")
def ins_trend(t):
    found = findings.trend(Facts(t.orders, _ROLES), always=True)
    if found is None:  # fewer than two days
        return t.spark.createDataFrame([("trend", None)], "name string, value double")
    return _numbers(t.orders, found, "trend")


@query("ins_change", """
    WITH h AS (SELECT value, row_number() OVER (ORDER BY ts) <= FLOOR(COUNT(*) OVER () / 2) AS early FROM
        (SELECT ts, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN value * 2 ELSE value END AS value FROM events))
    SELECT 'change_pct' AS name, ROUND((AVG(value) FILTER (NOT early) - AVG(value) FILTER (early)) / AVG(value) FILTER (early) * 100, 2) AS value FROM h""")
def ins_change(t):
    grown = t.events.withColumn("value", F.expr("CASE WHEN ts > TIMESTAMP_NTZ '2024-01-20 00:00:00' THEN value * 2 ELSE value END"))
    return _numbers(grown, findings.change(Facts(grown, _EVENT_ROLES)), "change_pct")


@query("ins_top", """
    SELECT o_orderpriority AS label, ROUND(SUM(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 8""")
def ins_top(t):
    return _points(t.orders, findings.top_performer(Facts(t.orders, _ROLES)))


@query("ins_contribution", """
    SELECT o_orderstatus AS label, ROUND(SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders) * 100, 1) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 6""")
def ins_contribution(t):
    return _points(t.orders, findings.contribution(Facts(t.orders, _ROLES)))


@query("ins_segment", "SELECT event_type AS label, ROUND(AVG(value), 4) AS value FROM events GROUP BY 1")
def ins_segment(t):
    return _points(t.events, findings.segment(Facts(t.events, _EVENT_ROLES)), 4)


@query("ins_correlation", f"""
    SELECT 'r' AS name, ROUND(corr(l_extendedprice, gross), 4) AS value FROM {_LINES} UNION ALL SELECT 'effect_size', ROUND(abs(corr(l_extendedprice, gross)), 4) FROM {_LINES}""")
def ins_correlation(t):
    lines = _lines(t)
    return _numbers(lines, findings.correlation(Facts(lines, {"metrics": _NUM})), "r", "effect_size")


@query("ins_anomaly", """
    WITH s AS (SELECT AVG(value) m, stddev_samp(value) sd, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events),
    f AS (SELECT value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS i, abs((value - m) / sd) > 2.8 AS z, abs((value - m) / sd) AS score FROM events, s)
    SELECT 'n_anomalies' AS name, COUNT(*) FILTER (i OR z)::DOUBLE AS value FROM f UNION ALL SELECT 'n_iqr', COUNT(*) FILTER (i)::DOUBLE FROM f
    UNION ALL SELECT 'n_zscore', COUNT(*) FILTER (z)::DOUBLE FROM f UNION ALL SELECT 'n_both', COUNT(*) FILTER (i AND z)::DOUBLE FROM f
    UNION ALL SELECT 'worst_value', ROUND(arg_max(value, score), 4) FROM f WHERE i OR z UNION ALL SELECT 'worst_zscore', ROUND(MAX(score), 3) FROM f WHERE i OR z""")
def ins_anomaly(t):
    return _numbers(t.events, findings.anomaly(Facts(t.events, _EVENT_ROLES)), "n_anomalies", "n_iqr", "n_zscore", "n_both",
                    "worst_value", "worst_zscore")


_HEAVY = "(SELECT l_quantity * l_quantity * l_quantity AS cube, exp(l_discount * 60) AS burst, l_tax FROM lineitem)"


def _heavy(t):
    return t.lineitem.selectExpr("l_quantity * l_quantity * l_quantity AS cube", "exp(l_discount * 60) AS burst", "l_tax")


def _fence(c):
    return (f"{c} < (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {_HEAVY}) OR "
            f"{c} > (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {_HEAVY})")


@query("ins_outliers", f"""
    WITH f AS (SELECT ({_fence('cube')}) AS a, ({_fence('burst')}) AS b, ({_fence('l_tax')}) AS c FROM {_HEAVY})
    SELECT 'n_outlier_rows' AS name, COUNT(*) FILTER (a OR b OR c)::DOUBLE AS value FROM f
    UNION ALL SELECT 'outlier_row_pct', ROUND(COUNT(*) FILTER (a OR b OR c) * 100.0 / COUNT(*), 1) FROM f""")
def ins_outliers(t):
    heavy = _heavy(t)
    found = findings.outlier_summary(Facts(heavy, {"metrics": ["cube", "burst", "l_tax"]}))
    return _numbers(heavy, found, "n_outlier_rows", "outlier_row_pct")


@query("ins_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS label, ROUND(abs(stddev_samp({c}) / AVG({c})) * 100, 1) AS value FROM {_HEAVY}" for c in ("cube", "burst", "l_tax")))
def ins_numeric(t):
    heavy = _heavy(t)
    return _points(heavy, findings.numeric_summary(Facts(heavy, {"metrics": ["cube", "burst", "l_tax"]})))


@query("ins_distribution", " UNION ALL ".join(f"SELECT '{n}' AS name, ROUND({e}, 4) AS value FROM events" for n, e in (
    ("mean", "AVG(value)"), ("median", "median(value)"), ("std", "stddev_samp(value)"), ("skewness", "skewness(value)"),
    ("kurtosis", "kurtosis(value)"), ("q1", "quantile_cont(value, 0.25)"), ("q3", "quantile_cont(value, 0.75)"),
    ("p10", "quantile_cont(value, 0.1)"), ("p90", "quantile_cont(value, 0.9)"))))
def ins_distribution(t):
    return _numbers(t.events, findings.distribution(Facts(t.events, _EVENT_ROLES)), "mean", "median", "std", "skewness",
                    "kurtosis", "q1", "q3", "p10", "p90")


@query("ins_categorical", """
    WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus v, COUNT(*) n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders GROUP BY 2),
    s AS (SELECT *, n * 1.0::DOUBLE / SUM(n) OVER (PARTITION BY "column") AS p FROM c)
    SELECT "column", ROUND(SUM(-p * ln(p + 1e-10)), 6) AS entropy, COUNT(*) AS levels FROM s GROUP BY 1""")
def ins_categorical(t):
    out = findings.entropy_table(t.orders, ["o_orderstatus", "o_orderpriority"])
    return out.select("column", F.round("entropy", 6).alias("entropy"), "levels")


@query("ins_category_shares", """
    SELECT o_orderstatus AS label, COUNT(*)::DOUBLE AS n, (SELECT ROUND(MAX(n) * 100.0 / SUM(n), 1) FROM (SELECT COUNT(*) n FROM orders GROUP BY o_orderstatus)) AS dominant_pct
    FROM orders GROUP BY 1""")
def ins_category_shares(t):
    found = findings.categorical(Facts(t.orders, _ROLES))
    rows = [(label, n, float(found.meta["dominant_pct"])) for label, n in zip(found.labels, found.values)]
    return t.spark.createDataFrame(rows, "label string, n double, dominant_pct double")


@query("fx_entropy", """
    WITH c AS (SELECT p_brand v, COUNT(*) n FROM part GROUP BY 1), s AS (SELECT n * 1.0::DOUBLE / SUM(n) OVER () AS p FROM c)
    SELECT ROUND(SUM(-p * ln(p + 1e-10)), 6) AS entropy FROM s""")
def fx_entropy(t):
    return findings.entropy_table(t.part, ["p_brand"]).select(F.round("entropy", 6).alias("entropy"))


@query("ins_quality", """
    WITH g AS (SELECT COUNT(*) FILTER (l_orderkey % 7 = 0) AS m, COUNT(*) n FROM lineitem)
    SELECT 'total_missing' AS name, m::DOUBLE AS value FROM g UNION ALL SELECT 'overall_pct', ROUND(m * 100.0 / (n * 2), 1) FROM g UNION ALL SELECT 'n_cols_affected', 1.0::DOUBLE FROM g""")
def ins_quality(t):
    data = t.lineitem.selectExpr("l_partkey", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty")
    found = findings.data_quality(Facts(data, {}))
    return _numbers(data, found, "total_missing", "overall_pct", "n_cols_affected")


@query("ins_drivers", " UNION ALL ".join(
    f"SELECT '{c}' AS label, ROUND(abs(corr(l_quantity, {c})), 6) AS value FROM {_LINES}" for c in _NUM[1:]))
def ins_drivers(t):
    lines = _lines(t)
    return _points(lines, findings.drivers(Facts(lines, {"metrics": _NUM})), 6)


@query("ins_forecast")
def ins_forecast(t):
    return insight_table(t.orders, [findings.forecast(Facts(t.orders, _ROLES))])


@query("insights_run")
def insights_run(t):
    return insight_table(t.orders, run_insights(t.orders, _ROLES))


@query("insight_report")
def insight_report_query(t):
    report = insight_report(run_insights(t.events, _EVENT_ROLES))
    return t.spark.createDataFrame([(i, line) for i, line in enumerate(report.split("\n"))], "line_no int, line string")


# ---- time series

@query("ts_resample", """
    WITH s AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, SUM(o_totalprice) v FROM orders GROUP BY 1, 2),
    b AS (SELECT o_orderpriority, MIN(period) lo, MAX(period) hi FROM s GROUP BY 1),
    c AS (SELECT o_orderpriority, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM b)
    SELECT c.o_orderpriority, c.period, ROUND(COALESCE(v, 0), 2) AS value FROM c LEFT JOIN s ON s.o_orderpriority = c.o_orderpriority AND s.period = c.period""")
def ts_resample(t):
    out = series.resample(t.orders, "o_orderdate", "o_totalprice", "M", ["o_orderpriority"])
    return out.withColumn("value", F.round("value", 2))


@query("ts_resample_week", """
    WITH s AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS period, SUM(o_totalprice) v FROM orders GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series((SELECT MIN(period) FROM s), (SELECT MAX(period) FROM s), INTERVAL 7 DAY)) AS DATE) AS period)
    SELECT c.period, ROUND(COALESCE(v, 0), 2) AS value FROM c LEFT JOIN s ON s.period = c.period""")
def ts_resample_week(t):
    return series.resample(t.orders, "o_orderdate", "o_totalprice", "W").withColumn("value", F.round("value", 2))


_MONTHS = """(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, SUM(o_totalprice) AS value FROM orders GROUP BY 1)"""


def _months(t):
    return series.resample(t.orders, "o_orderdate", "o_totalprice", "M")


@query("win_pct_change", """
    WITH d AS (SELECT CAST(ts AS DATE) AS period, SUM(value) v FROM events GROUP BY 1)
    SELECT period, ROUND(v, 2) AS value, ROUND(v / lag(v) OVER (ORDER BY period) - 1, 6) AS pct_change FROM d""")
def win_pct_change(t):
    out = series.pct_change(series.daily_sums(t.events, "ts", "value"))
    return out.withColumns({"value": F.round("value", 2), "pct_change": F.round("pct_change", 6)})


@query("win_lag_features", f"""
    SELECT period, ROUND(COALESCE(lag(value, 1) OVER w, 0), 2) AS lag_1, ROUND(COALESCE(lag(value, 2) OVER w, 0), 2) AS lag_2,
      ROUND(COALESCE(lag(value, 3) OVER w, 0), 2) AS lag_3, ROUND(COALESCE(lag(value, 7) OVER w, 0), 2) AS lag_7,
      ROUND(COALESCE(AVG(value) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 2) AS mean_3,
      ROUND(COALESCE(stddev_pop(value) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 2) AS std_3,
      CAST(row_number() OVER w - 1 AS INTEGER) AS position FROM {_MONTHS} WINDOW w AS (ORDER BY period)""")
def win_lag_features(t):
    out = series.lag_features(_months(t), lags=(1, 2, 3, 7))
    return out.select("period", *[F.round(c, 2).alias(c) for c in ("lag_1", "lag_2", "lag_3", "lag_7", "mean_3", "std_3")],
                      "position")


@query("win_rolling_trend", f"""
    SELECT period, ROUND(AVG(value) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 2) AS trend FROM {_MONTHS}""")
def win_rolling_trend(t):
    return series.rolling_trend(_months(t), 7).select("period", F.round("trend", 2).alias("trend"))


@query("ts_freq", "SELECT 'orders' AS source, 'D' AS frequency FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'months', 'M' FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'events', CASE WHEN (SELECT median(g) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS g FROM events)) < 3600000000 THEN 'T' ELSE 'H' END")
def ts_freq(t):
    rows = [("orders", series.infer_frequency(t.orders, "o_orderdate")),
            ("months", series.infer_frequency(_months(t), "period")),
            ("events", series.infer_frequency(t.events, "ts"))]
    return t.spark.createDataFrame(rows, "source string, frequency string")


@query("ts_horizon", """
    SELECT i::INTEGER AS step, CAST((SELECT MAX(date_trunc('month', o_orderdate)) FROM orders) + to_months(i::INTEGER) AS DATE) AS period FROM range(1, 7) r(i)""")
def ts_horizon(t):
    return series.future_periods(_months(t), "M")


@query("ts_summary", f"""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM {_MONTHS}),
    s AS (SELECT arg_min(value, period) a, arg_max(value, period) b, COUNT(*) n, SUM(value) total, AVG(value) m, regr_slope(value, i) k FROM n)
    SELECT ROUND(a, 2) AS start_val, ROUND(b, 2) AS end_val, ROUND((b - a) / abs(a) * 100, 1) AS growth_pct, ROUND(total, 2) AS total, n AS n_points, ROUND(k, 4) AS slope,
      CASE WHEN k > abs(m) * 0.005 THEN 'upward' WHEN k < -abs(m) * 0.005 THEN 'downward' ELSE 'stable' END AS direction FROM s""")
def ts_summary(t):
    return series.summarize(_months(t))


@query("ts_decompose", f"""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, COUNT(*) OVER () AS n FROM {_MONTHS}),
    m AS (SELECT *, CASE WHEN i >= 6 AND i <= n - 7 THEN (SUM(value) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
        - 0.5 * (lag(value, 6) OVER (ORDER BY i) + lead(value, 6) OVER (ORDER BY i))) / 12 END AS core FROM n),
    h AS (SELECT regr_slope(core, i) k, regr_intercept(core, i) c FROM m WHERE i >= 6 AND i < 18),
    e AS (SELECT regr_slope(core, i) k, regr_intercept(core, i) c FROM m WHERE i <= n - 7 AND i > n - 19),
    t AS (SELECT m.*, COALESCE(core, CASE WHEN i < 6 THEN h.c + h.k * i ELSE e.c + e.k * i END) AS trend FROM m, h, e),
    p AS (SELECT i % 12 AS ph, AVG(value - trend) AS s FROM t GROUP BY 1)
    SELECT period, ROUND(trend, -1) AS trend, ROUND(s - (SELECT AVG(s) FROM p), -1) AS seasonal FROM t JOIN p ON p.ph = t.i % 12""")
def ts_decompose(t):
    out = series.decompose(_months(t), "M")
    # means of cents often end in an exact half cent, where float sums of another order round differently
    return out.select("period", F.round("trend", -1).alias("trend"), F.round("seasonal", -1).alias("seasonal"))


@query("fc_mape", """
    SELECT ROUND(AVG(abs((l_extendedprice - l_quantity * 2000) / l_extendedprice)) * 100, 4) AS mape FROM lineitem WHERE l_extendedprice <> 0""")
def fc_mape(t):
    return t.lineitem.agg(F.round(series.mape(F.col("l_extendedprice"), F.col("l_quantity") * 2000), 4).alias("mape"))


@query("fc_ses", f"""
    WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY period) AS i, value FROM {_MONTHS}),
    l(i, level) AS (SELECT 1::BIGINT, value FROM n WHERE i = 1 UNION ALL SELECT n.i, 0.3 * n.value + 0.7 * l.level FROM l JOIN n ON n.i = l.i + 1),
    k AS (SELECT COUNT(*) n, GREATEST(2, CAST(FLOOR(COUNT(*) / 5) AS BIGINT)) w FROM n),
    s AS (SELECT regr_slope(value, i) slope FROM n, k WHERE i > k.n - k.w)
    SELECT CAST(h AS INTEGER) AS step, ROUND(level + slope * h, 1) AS point FROM l, s, range(1, 7) r(h) WHERE l.i = (SELECT n FROM k)""")
def fc_ses(t):
    return forecast_table(_months(t), "M", model="ses").select("step", F.round("point", 1).alias("point"))


def _model(name):
    def run(t):
        table = series.resample(t.orders, "o_orderdate", "o_totalprice", "M", ["o_orderpriority"])
        return forecast_table(table, "M", series=["o_orderpriority"], model=name)
    return run


for _name in ("holt_winters", "ridge_lag", "arima"):
    query(f"fc_{_name}")(_model(_name))


@query("fc_bands", """
    WITH s AS (SELECT o_orderpriority, date_trunc('month', MAX(o_orderdate)) AS last, date_diff('month', MIN(o_orderdate), MAX(o_orderdate)) + 1 AS n
        FROM orders GROUP BY 1 UNION ALL SELECT 'first day', date_trunc('month', MIN(o_orderdate)), 1 FROM orders),
    m AS (SELECT unnest(['holt_winters', 'ridge_lag', 'arima', 'ensemble']) AS model),
    h AS (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step)
    SELECT model, o_orderpriority, step, CAST(last + to_months(step) AS DATE) AS period, TRUE AS in_order, TRUE AS widening
    FROM s, m, h WHERE n >= 8
    UNION ALL SELECT model, o_orderpriority, NULL, NULL, NULL, NULL FROM s, m WHERE n < 8""")
def fc_bands(t):
    first = t.orders.agg(F.min("o_orderdate")).first()[0]
    rows = t.orders.unionByName(t.orders.where(F.col("o_orderdate") == F.lit(first)).withColumn("o_orderpriority", F.lit("first day")))
    table = series.resample(rows, "o_orderdate", "o_totalprice", "M", ["o_orderpriority"])
    inside = (F.col("lower_95") <= F.col("lower_80")) & (F.col("lower_80") <= F.col("point")) & (
        F.col("point") <= F.col("upper_80")) & (F.col("upper_80") <= F.col("upper_95"))
    by_series = Window.partitionBy("o_orderpriority").orderBy("step")
    width = F.col("upper_95") - F.col("lower_95")
    parts = []
    for name in ("holt_winters", "ridge_lag", "arima", None):
        ahead = forecast_table(table, "M", series=["o_orderpriority"], model=name)
        wider = F.when(width.isNotNull(), F.coalesce(width > F.lag(width).over(by_series), F.lit(True)))
        parts.append(ahead.select(F.lit(name or "ensemble").alias("model"), "o_orderpriority", "step", "period",
                                  inside.alias("in_order"), wider.alias("widening")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("fc_ensemble")
def fc_ensemble(t):
    return run_forecast(t.orders, "o_orderdate", "o_totalprice", frequency="M", series=["o_orderpriority"])
