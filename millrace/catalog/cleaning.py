"""Cleaning rules, ordered fills and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import features, fuzzy, impute, ordered
from millrace.plans.cleaning import clean_auto, clean_rules, rule_diff

# no given table holds a NULL, so gaps are made by key arithmetic on both sides
_GAPPY = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag,
    CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"""


def gappy(t):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price",
        "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag",
        "CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_tax END AS tax")


_KEY = "l_orderkey, l_linenumber, l_partkey"


def _picked(df, *names):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *names)


def _rounded(df, **digits):
    return df.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query("impute_mean", f"""
    SELECT {_KEY}, ROUND(COALESCE(qty, (SELECT AVG(qty) FROM {_GAPPY})), 6) AS qty,
           ROUND(COALESCE(price, (SELECT AVG(price) FROM {_GAPPY})), 3) AS price FROM {_GAPPY}""")
def impute_mean(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "columns": ["qty", "price"], "impute_method": "mean"}]).df
    return _rounded(_picked(out, "qty", "price"), qty=6, price=3)


@query("impute_median", f"""
    SELECT {_KEY}, COALESCE(qty, (SELECT median(qty) FROM {_GAPPY})) AS qty,
           ROUND(COALESCE(price, (SELECT median(price) FROM {_GAPPY})), 4) AS price FROM {_GAPPY}""")
def impute_median(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "columns": ["qty", "price"], "impute_method": "median"}]).df
    return _rounded(_picked(out, "qty", "price"), price=4)


@query("impute_trimmed_mean", f"""
    SELECT {_KEY}, ROUND(COALESCE(price, (SELECT AVG(price) FROM
        (SELECT price, row_number() OVER (ORDER BY price) AS rn, COUNT(*) OVER () AS n FROM {_GAPPY} WHERE price IS NOT NULL)
        WHERE rn > CAST(FLOOR(0.1 * n) AS BIGINT) AND rn <= n - CAST(FLOOR(0.1 * n) AS BIGINT))), 3) AS price FROM {_GAPPY}""")
def impute_trimmed_mean(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "column": "price", "impute_method": "mean",
                                  "trim_percent": 0.1}]).df
    return _rounded(_picked(out, "price"), price=3)


@query("impute_mode", f"""
    SELECT {_KEY}, COALESCE(flag, (SELECT flag FROM {_GAPPY} WHERE flag IS NOT NULL GROUP BY flag
        ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag,
        COALESCE(qty, (SELECT qty FROM {_GAPPY} WHERE qty IS NOT NULL GROUP BY qty ORDER BY COUNT(*) DESC, qty LIMIT 1)) AS qty
    FROM {_GAPPY}""")
def impute_mode(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "columns": ["flag", "qty"], "impute_method": "mode"}]).df
    return _picked(out, "flag", "qty")


@query("impute_zero", f"SELECT {_KEY}, COALESCE(qty, 0) AS qty, COALESCE(tax, 0) AS tax FROM {_GAPPY}")
def impute_zero(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "columns": ["qty", "tax"], "impute_method": "zero"}]).df
    return _picked(out, "qty", "tax")


@query("impute_constant", f"SELECT {_KEY}, COALESCE(flag, 'N/A') AS flag, COALESCE(qty, -1.5) AS qty FROM {_GAPPY}")
def impute_constant(t):
    out = clean_rules(gappy(t), [
        {"action_type": "impute", "column": "flag", "impute_method": "constant"},
        {"action_type": "impute", "column": "qty", "impute_method": "constant", "fill_value": -1.5}]).df
    return _picked(out, "flag", "qty")


@query("impute_drop_rows", f"SELECT {_KEY}, qty, price FROM {_GAPPY} WHERE qty IS NOT NULL AND price IS NOT NULL")
def impute_drop_rows(t):
    out = clean_rules(gappy(t), [{"action_type": "impute", "columns": ["qty", "price"], "impute_method": "drop_rows"}]).df
    return _picked(out, "qty", "price")


@query("impute_auto", f"""
    SELECT {_KEY}, ROUND(COALESCE(qty, (SELECT CASE WHEN abs(skewness(qty)) > 1 THEN median(qty) ELSE AVG(qty) END FROM {_GAPPY})), 6) AS qty,
           ROUND(COALESCE(price, (SELECT CASE WHEN abs(skewness(price)) > 1 THEN median(price) ELSE AVG(price) END FROM {_GAPPY})), 3) AS price,
           COALESCE(flag, (SELECT flag FROM {_GAPPY} WHERE flag IS NOT NULL GROUP BY flag ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag,
           qty IS NULL AS qty_imputed FROM {_GAPPY}""")
def impute_auto(t):
    out = impute.impute_auto(gappy(t), flag=True).df
    assert "tax" not in out.columns
    return _rounded(_picked(out, "qty", "price", "flag", "qty_imputed"), qty=6, price=3)


_EVENT_GAPS = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 4 = 1 OR event_id % 9 < 3 THEN NULL ELSE value END AS v
                  FROM events)"""


def event_gaps(t):
    return t.events.selectExpr(
        "event_id", "ts", "user_id", "CASE WHEN event_id % 4 = 1 OR event_id % 9 < 3 THEN NULL ELSE value END AS v")


@query("win_ffill", f"""
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS v FROM {_EVENT_GAPS}""")
def win_ffill(t):
    out = clean_rules(event_gaps(t), [{"action_type": "impute", "column": "v", "impute_method": "ffill",
                                       "order_by": ["ts", "event_id"], "partition_by": ["user_id"]}]).df
    return out.select("event_id", "v")


@query("win_ffill_limit", f"""
    SELECT event_id, COALESCE(v, lag(v) OVER (ORDER BY ts, event_id)) AS v FROM {_EVENT_GAPS}""")
def win_ffill_limit(t):
    return ordered.fill(event_gaps(t), ["v"], ["ts", "event_id"], limit=1).select("event_id", "v")


@query("win_bfill", f"""
    SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_EVENT_GAPS}""")
def win_bfill(t):
    out = clean_rules(event_gaps(t), [{"action_type": "impute", "column": "v", "impute_method": "bfill",
                                       "order_by": ["ts", "event_id"]}]).df
    return out.select("event_id", "v")


@query("win_interp", f"""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {_EVENT_GAPS}),
    p AS (SELECT *, CASE WHEN v IS NULL THEN NULL ELSE rn END AS kn FROM n),
    e AS (SELECT *, last_value(kn IGNORE NULLS) OVER w AS pr, last_value(v IGNORE NULLS) OVER w AS pv,
            first_value(kn IGNORE NULLS) OVER u AS nr, first_value(v IGNORE NULLS) OVER u AS nv FROM p
          WINDOW w AS (ORDER BY rn ROWS UNBOUNDED PRECEDING), u AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, ROUND(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
        ELSE pv + (nv - pv) * ((rn - pr)::DOUBLE / (nr - pr)) END, 6) AS v FROM e""")
def win_interp(t):
    out = clean_rules(event_gaps(t), [{"action_type": "impute", "column": "v", "impute_method": "interpolate",
                                       "order_by": ["ts", "event_id"]}]).df
    return _rounded(out.select("event_id", "v"), v=6)


@query("impute_polynomial", f"""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM {_EVENT_GAPS}),
    k AS (SELECT pos, v, row_number() OVER (ORDER BY pos) AS nth FROM n WHERE v IS NOT NULL),
    g AS (SELECT * FROM (SELECT event_id, v, pos AS here, COUNT(v) OVER (ORDER BY pos) AS b, COUNT(v) OVER () AS known FROM n) WHERE v IS NULL),
    c AS (SELECT g.event_id, here, k.pos, k.v, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(k.pos - here), k.pos) AS r
        FROM g JOIN k ON nth BETWEEN b - 1 AND b + 2 WHERE b > 0 AND b < known),
    p AS (SELECT event_id, MAX(here)::DOUBLE AS x, MAX(pos) FILTER (r = 1)::DOUBLE AS x1, MAX(v) FILTER (r = 1) AS v1, MAX(pos) FILTER (r = 2)::DOUBLE AS x2,
            MAX(v) FILTER (r = 2) AS v2, MAX(pos) FILTER (r = 3)::DOUBLE AS x3, MAX(v) FILTER (r = 3) AS v3 FROM c GROUP BY 1),
    e AS (SELECT g.event_id, k.v FROM g JOIN k ON k.nth = CASE WHEN b = 0 THEN 1 ELSE known END WHERE b = 0 OR b = known)
    SELECT event_id, ROUND(v, 5) AS v FROM (
        SELECT event_id, v FROM n WHERE v IS NOT NULL UNION ALL SELECT event_id, v FROM e UNION ALL
        SELECT event_id, v1 * (x - x2) * (x - x3) / ((x1 - x2) * (x1 - x3)) + v2 * (x - x1) * (x - x3) / ((x2 - x1) * (x2 - x3))
            + v3 * (x - x1) * (x - x2) / ((x3 - x1) * (x3 - x2)) FROM p)""")
def impute_polynomial(t):
    out = clean_rules(event_gaps(t), [{"action_type": "impute", "column": "v", "impute_method": "interpolate",
                                       "interp_method": "polynomial", "interp_order": 2,
                                       "order_by": ["ts", "event_id"]}]).df
    return _rounded(out.select("event_id", "v"), v=5)


@query("impute_spline", """
    WITH RECURSIVE s AS (SELECT o_custkey AS g, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
    k AS (SELECT g, pos, v, row_number() OVER w AS i, COUNT(*) OVER (PARTITION BY g) AS n, pos - lag(pos) OVER w AS h0,
        lead(pos) OVER w - pos AS h1, v - lag(v) OVER w AS d0, lead(v) OVER w - v AS d1
        FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY pos)),
    f AS (SELECT g, i, n, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM k WHERE i = 1
        UNION ALL SELECT k.g, k.i, k.n, CASE WHEN k.i = k.n THEN 0.0 ELSE h1 / (2 * (h0 + h1) - h0 * f.c) END,
            CASE WHEN k.i = k.n THEN 0.0 ELSE (6 * (d1 / h1 - d0 / h0) - h0 * f.d) / (2 * (h0 + h1) - h0 * f.c) END
        FROM f JOIN k ON k.g = f.g AND k.i = f.i + 1),
    b AS (SELECT g, i, 0.0::DOUBLE AS m FROM f WHERE i = n
        UNION ALL SELECT f.g, f.i, f.d - f.c * b.m FROM b JOIN f ON f.g = b.g AND f.i = b.i - 1),
    p AS (SELECT s.*, SUM(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY pos) AS i,
        COUNT(v) OVER (PARTITION BY g) AS n FROM s),
    e AS (SELECT p.g, p.o_orderkey, p.v, p.pos, p.i, p.n, x.pos AS x0, x.v AS y0, y.pos AS x1, y.v AS y1, q.m AS m0, r.m AS m1,
            (y.pos - x.pos)::DOUBLE AS h FROM p
        LEFT JOIN k x ON x.g = p.g AND x.i = p.i LEFT JOIN k y ON y.g = p.g AND y.i = p.i + 1
        LEFT JOIN b q ON q.g = p.g AND q.i = p.i LEFT JOIN b r ON r.g = p.g AND r.i = p.i + 1)
    SELECT o_orderkey, ROUND(CASE WHEN v IS NOT NULL THEN v WHEN i = 0 THEN y1 WHEN i = n THEN y0
        ELSE (x1 - pos) / h * y0 + (pos - x0) / h * y1 + ((pow((x1 - pos) / h, 3) - (x1 - pos) / h) * m0
              + (pow((pos - x0) / h, 3) - (pos - x0) / h) * m1) * h * h / 6 END, 2) AS o_totalprice FROM e""")
def impute_spline(t):
    data = t.orders.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END"))
    out = clean_rules(data, [{"action_type": "impute", "column": "o_totalprice", "impute_method": "interpolate",
                              "interp_method": "spline", "order_by": ["o_orderdate", "o_orderkey"],
                              "partition_by": ["o_custkey"]}]).df
    return _rounded(out.select("o_orderkey", "o_totalprice"), o_totalprice=2)


@query("win_row_number", """
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders""")
def win_row_number(t):
    return ordered.number_rows(t.orders, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "row_no")


@query("win_halves", """
    SELECT half, COUNT(*) AS n, ROUND(AVG(value), 4) AS mean FROM
      (SELECT value, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= FLOOR(COUNT(*) OVER () / 2) THEN 1 ELSE 2 END AS half FROM events)
    GROUP BY half""")
def win_halves(t):
    halves = ordered.split_halves(t.events, ["ts", "event_id"])
    return halves.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("win_running_total", """
    SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total
    FROM events""")
def win_running_total(t):
    out = ordered.running_total(t.events, "value", ["ts", "event_id"], ["event_type"])
    return out.select("event_id", F.round("total", 2).alias("total"))


@query("win_avg_over", """
    SELECT o_orderkey, ROUND(o_totalprice - (SELECT AVG(o_totalprice) FROM orders), 3) AS apart FROM orders""")
def win_avg_over(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("mean"))
    return t.orders.crossJoin(F.broadcast(mean)).select(
        "o_orderkey", F.round(F.col("o_totalprice") - F.col("mean"), 3).alias("apart"))


# ---- outliers

_Q = "quantile_cont"


@query("outlier_iqr", f"""
    WITH f AS (SELECT {_Q}(l_extendedprice, 0.25) q1, {_Q}(l_extendedprice, 0.75) q3 FROM lineitem)
    SELECT {_KEY}, ROUND(LEAST(GREATEST(l_extendedprice, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1)), 3) AS l_extendedprice
    FROM lineitem, f""")
def outlier_iqr(t):
    out = clean_rules(t.lineitem, [{"action_type": "outlier", "column": "l_extendedprice", "multiplier_k": 0.2}]).df
    return _rounded(_picked(out, "l_extendedprice"), l_extendedprice=3)


@query("outlier_zscore", """
    WITH f AS (SELECT AVG(c_acctbal) m, stddev_samp(c_acctbal) s FROM customer)
    SELECT customer.* FROM customer, f WHERE abs(c_acctbal - m) / s <= 1.6""")
def outlier_zscore(t):
    return clean_rules(t.customer, [{"action_type": "outlier", "column": "c_acctbal", "outlier_method": "zscore",
                                     "zscore_threshold": 1.6, "outlier_action": "drop_rows"}]).df


@query("outlier_mad", """
    WITH m AS (SELECT median(value) med FROM events),
    f AS (SELECT MIN(med) med, median(abs(value - med)) * 1.4826 AS scale FROM events, m)
    SELECT event_id, CASE WHEN abs(value - med) / scale > 3 THEN NULL ELSE value END AS value FROM events, f""")
def outlier_mad(t):
    out = clean_rules(t.events, [{"action_type": "outlier", "column": "value", "outlier_method": "mad",
                                  "outlier_action": "nullify"}]).df
    return out.select("event_id", "value")


@query("outlier_percentile", f"""
    WITH f AS (SELECT {_Q}(value, 0.02) lo, {_Q}(value, 0.98) hi, median(value) med FROM events)
    SELECT event_id, ROUND(CASE WHEN value < lo OR value > hi THEN med ELSE value END, 4) AS value FROM events, f""")
def outlier_percentile(t):
    out = clean_rules(t.events, [{"action_type": "outlier", "column": "value", "outlier_method": "percentile",
                                  "lower_percentile": 0.02, "upper_percentile": 0.98,
                                  "outlier_action": "fill_median"}]).df
    return _rounded(out.select("event_id", "value"), value=4)


@query("outlier_actions", f"""
    WITH f AS (SELECT AVG(value) m, stddev_samp(value) s, {_Q}(value, 0.01) lo, {_Q}(value, 0.99) hi FROM events)
    SELECT event_id, ROUND(LEAST(GREATEST(value, lo), hi), 4) AS value FROM events, f""")
def outlier_actions(t):
    out = clean_rules(t.events, [{"action_type": "outlier", "column": "value", "outlier_method": "zscore"}]).df
    return _rounded(out.select("event_id", "value"), value=4)


@query("outlier_iforest")
def outlier_iforest(t):
    return clean_rules(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), [
        {"action_type": "outlier", "columns": ["o_totalprice", "c_acctbal"], "outlier_method": "isolation_forest",
         "iso_contamination": 0.02, "outlier_action": "drop_rows"}]).df.select("o_orderkey", "o_totalprice", "c_acctbal")


# ---- scale, encode, cast

@query("scale_robust", f"""
    WITH f AS (SELECT median(l_extendedprice) m, {_Q}(l_extendedprice, 0.1) lo, {_Q}(l_extendedprice, 0.9) hi FROM lineitem)
    SELECT {_KEY}, ROUND((l_extendedprice - m) / (hi - lo), 6) AS l_extendedprice FROM lineitem, f""")
def scale_robust(t):
    out = clean_rules(t.lineitem, [{"action_type": "scale", "column": "l_extendedprice", "quantile_low": 10,
                                    "quantile_high": 90}]).df
    return _rounded(_picked(out, "l_extendedprice"), l_extendedprice=6)


@query("scale_standard", """
    WITH f AS (SELECT AVG(c_acctbal) m, stddev_samp(c_acctbal) s FROM customer)
    SELECT c_custkey, ROUND((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, f""")
def scale_standard(t):
    out = clean_rules(t.customer, [{"action_type": "scale", "column": "c_acctbal", "scaler_method": "standard"}]).df
    return _rounded(out.select("c_custkey", "c_acctbal"), c_acctbal=6)


@query("scale_minmax", """
    WITH f AS (SELECT MIN(p_size) lo, MAX(p_size) hi, MIN(p_retailprice) rl, MAX(p_retailprice) rh FROM part)
    SELECT p_partkey, ROUND((p_size - lo)::DOUBLE / (hi - lo) * 3 - 1, 6) AS p_size,
           ROUND((p_retailprice - rl) / (rh - rl) * 3 - 1, 6) AS p_retailprice FROM part, f""")
def scale_minmax(t):
    out = clean_rules(t.part, [{"action_type": "scale", "columns": ["p_size", "p_retailprice", "p_name"],
                                "scaler_method": "minmax", "scale_min": -1, "scale_max": 2}]).df
    return _rounded(out.select("p_partkey", "p_size", "p_retailprice"), p_size=6, p_retailprice=6)


@query("encode_onehot", """
    SELECT c_custkey, c_mktsegment = 'BUILDING' AS "c_mktsegment_BUILDING", c_mktsegment = 'FURNITURE' AS "c_mktsegment_FURNITURE",
           c_mktsegment = 'HOUSEHOLD' AS "c_mktsegment_HOUSEHOLD", c_mktsegment = 'MACHINERY' AS "c_mktsegment_MACHINERY"
    FROM customer""")
def encode_onehot(t):
    out = clean_rules(t.customer, [{"action_type": "encode", "column": "c_mktsegment", "drop_first": True}]).df
    return out.select("c_custkey", *[c for c in out.columns if c.startswith("c_mktsegment_")])


@query("encode_ordinal", f"""
    WITH codes AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS code FROM (SELECT DISTINCT flag FROM {_GAPPY} WHERE flag IS NOT NULL))
    SELECT {_KEY}, CAST(COALESCE(code, -1) AS INTEGER) AS flag FROM {_GAPPY} g LEFT JOIN codes ON g.flag = codes.flag""")
def encode_ordinal(t):
    out = clean_rules(gappy(t), [{"action_type": "encode", "column": "flag", "encode_method": "ordinal"}]).df
    return _picked(out, "flag")


@query("cast", """
    SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_no,
           COALESCE(CAST(TRY_CAST(p_name AS DOUBLE) AS BIGINT), 0) AS name_no, CAST(p_size AS VARCHAR) AS p_size, p_partkey <> 0 AS flag
    FROM part""")
def cast(t):
    parts = t.part.select("p_partkey", F.split("p_brand", "#")[1].alias("brand_no"), F.col("p_name").alias("name_no"),
                          "p_size", F.col("p_partkey").alias("flag"))
    return clean_rules(parts, [
        {"action_type": "cast", "column": "brand_no", "cast_type": "float"},
        {"action_type": "cast", "column": "name_no", "cast_type": "int"},
        {"action_type": "cast", "column": "p_size", "cast_type": "string"},
        {"action_type": "cast", "column": "flag", "cast_type": "bool"}]).df


@query("cast_datetime", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS us, NULL::DATE AS bad FROM orders""")
def cast_datetime(t):
    texts = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
                            F.date_format("o_orderdate", "M/d/yyyy").alias("us"), F.col("o_orderstatus").alias("bad"))
    out = features.cast_lenient(texts, ["iso", "us", "bad"], "datetime")
    return out.withColumns({n: F.col(n).cast("date") for n in ("iso", "us", "bad")})


@query("cast_strict", "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def cast_strict(t):
    whole = t.orders.select("o_orderkey", F.floor("o_totalprice").cast("double").alias("o_totalprice"), "o_orderdate")
    return features.cast_strict(whole, {"o_totalprice": "BIGINT", "o_orderdate": "DATE"})


# ---- text

@query("text_case", """
    SELECT p_partkey, upper(p_name) AS p_name, lower(p_brand) AS p_brand,
           upper(p_type[1]) || lower(p_type[2:]) AS p_type FROM part""")
def text_case(t):
    padded = t.part.withColumn("p_type", F.concat(F.lit(" \t"), "p_type", F.lit("\n ")))
    out = clean_rules(padded, [
        {"action_type": "text", "column": "p_name", "text_case": "uppercase"},
        {"action_type": "text", "column": "p_brand", "text_case": "lowercase"},
        {"action_type": "normalize", "column": "p_type", "text_case": "titlecase"}]).df
    return out.select("p_partkey", "p_name", "p_brand", "p_type")


@query("text_regex", r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([aeiou])(n)', '<\2\1>', 'g')) AS digest FROM documents""")
def text_regex(t):
    out = clean_rules(t.documents, [{"action_type": "text", "column": "text", "regex_pattern": "([aeiou])(n)",
                                     "regex_replacement": r"<\2\1>"}]).df
    return out.select("doc_id", F.md5("text").alias("digest"))


_MAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"


@query("pii_mask", rf"""
    SELECT doc_id, length(m) AS n_chars, md5(m) AS digest FROM (SELECT doc_id,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'),
        '{_MAIL}', '[REDACTED_EMAIL]', 'g'), '\+?[\d\s\-\(\)]{{7,}}\b', '[REDACTED_PHONE]', 'g'),
        '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[REDACTED_SSN]', 'g'), '\b(?:\d{{4}}[ -]?){{3}}\d{{4}}\b', '[REDACTED_CARD]', 'g') AS m FROM documents)""")
def pii_mask(t):
    out = clean_rules(t.documents, [{"action_type": "text", "column": "text", "text_case": "none", "pii_mask": True,
                                     "pii_entities": ["email", "phone", "ssn", "credit_card"]}]).df
    # the SQL engine knows only ASCII word edges, so letters outside ASCII are compared as one letter
    plain = out.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return plain.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("pii_mask_turns", rf"""
    SELECT conv_id, turn, regexp_replace(text, '{_MAIL}', '[REDACTED_EMAIL]', 'g') AS text FROM conversations""")
def pii_mask_turns(t):
    out = clean_rules(t.conversations, [{"action_type": "text", "column": "text", "text_case": "none",
                                         "pii_mask": True, "pii_entities": ["email"]}]).df
    return out.select("conv_id", "turn", "text")


@query("fuzzy_dedupe")
def fuzzy_dedupe(t):
    return fuzzy.fuzzy_dedupe(t.part, "p_name", 0.8).select("p_partkey", "p_name")


# ---- whole pipelines

@query("struct_clean", """
    SELECT DISTINCT trim(c_name) AS name, TRY_CAST(trim(CAST(c_acctbal AS VARCHAR)) AS DOUBLE) AS acct_bal, c_custkey AS key
    FROM customer""")
def struct_clean(t):
    messy = t.customer.select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("Name"),
                              F.col("c_acctbal").cast("string").alias("AcctBal"), F.col("c_custkey").alias("Key "))
    hollow = t.region.select(F.lit(None).cast("string").alias("Name"), F.lit(None).cast("string").alias("AcctBal"),
                             F.lit(None).cast("bigint").alias("Key "))
    return features.structural_clean(messy.unionByName(messy.where("`Key ` % 2 = 0")).unionByName(hollow))[0]


@query("clean_auto", f"""
    SELECT DISTINCT {_KEY}, l_suppkey, l_shipdate, ROUND(COALESCE(qty, (SELECT AVG(qty) FROM {_GAPPY})), 6) AS qty,
           ROUND(COALESCE(price, (SELECT AVG(price) FROM {_GAPPY})), 3) AS price,
           COALESCE(flag, (SELECT flag FROM {_GAPPY} WHERE flag IS NOT NULL GROUP BY flag ORDER BY COUNT(*) DESC, flag LIMIT 1)) AS flag
    FROM {_GAPPY}""")
def clean_auto_query(t):
    return _rounded(clean_auto(gappy(t))[0].df, qty=6, price=3)


@query("clean_rules", f"""
    WITH a AS (SELECT {_KEY}, COALESCE(qty, (SELECT median(qty) FROM {_GAPPY})) AS qty, price, lower(COALESCE(flag, 'N/A')) AS flag FROM {_GAPPY}),
    f AS (SELECT {_Q}(price, 0.05) lo, {_Q}(price, 0.95) hi FROM a)
    SELECT {_KEY}, ROUND(qty / 50, 6) AS qty, ROUND(LEAST(GREATEST(price, lo), hi), 3) AS price, flag FROM a, f
    WHERE price IS NOT NULL""")
def clean_rules_query(t):
    out = clean_rules(gappy(t), [
        {"action_type": "drop", "columns": ["tax", "l_suppkey", "l_shipdate"]},
        {"action_type": "impute", "column": "qty", "impute_method": "median"},
        {"action_type": "impute", "column": "flag", "impute_method": "constant"},
        {"action_type": "outlier", "column": "price", "outlier_method": "percentile", "lower_percentile": 0.05,
         "upper_percentile": 0.95},
        {"action_type": "impute", "column": "price", "impute_method": "drop_rows"},
        {"action_type": "text", "column": "flag", "text_case": "lowercase"},
        {"action_type": "cast", "column": "qty", "cast_type": "float"}]).df
    return _rounded(out.withColumn("qty", F.col("qty") / 50), qty=6, price=3)


@query("rule_diff", """
    WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders
               ORDER BY o_orderkey LIMIT 1000)
    SELECT o_orderkey, amount IS NULL AS changed FROM s""")
def rule_diff_query(t):
    data = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount")
    rule = {"action_type": "impute", "column": "amount", "impute_method": "mean"}
    return rule_diff(data, rule, ["o_orderkey"])["diff"].select("o_orderkey", "changed")


@query("impute_knn", """
    WITH d AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS v FROM part),
    n AS (SELECT q.p_partkey, q.p_size, x.v, abs(q.p_size - x.p_size) AS far,
            row_number() OVER (PARTITION BY q.p_partkey ORDER BY abs(q.p_size - x.p_size), x.p_partkey) AS r
        FROM d q JOIN d x ON q.v IS NULL AND x.v IS NOT NULL),
    k AS (SELECT *, MIN(far) OVER (PARTITION BY p_partkey) AS nearest FROM n WHERE r <= 5)
    SELECT p_partkey, p_size, v AS p_retailprice FROM d WHERE v IS NOT NULL
    UNION ALL SELECT p_partkey, p_size, ROUND(SUM(v * CASE WHEN nearest > 0 THEN 1 / far WHEN far = 0 THEN 1.0 ELSE 0.0 END)
        / SUM(CASE WHEN nearest > 0 THEN 1 / far WHEN far = 0 THEN 1.0 ELSE 0.0 END), 6) FROM k GROUP BY 1, 2""")
def impute_knn(t):
    data = t.part.selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size",
                             "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice")
    return clean_rules(data, [{"action_type": "impute", "columns": ["p_size", "p_retailprice"], "impute_method": "knn",
                               "knn_neighbors": 5, "knn_weights": "distance", "key": ["p_partkey"]}]).df.withColumn(
        "p_retailprice", F.round("p_retailprice", 6))


@query("impute_mice")
def impute_mice(t):
    data = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty",
        "l_extendedprice", "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 3 + l_discount END AS mix")
    return clean_rules(data, [{"action_type": "impute", "columns": ["qty", "l_extendedprice", "mix"],
                               "impute_method": "mice", "mice_max_iter": 5}]).df


_ONE = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty, l_extendedprice AS price FROM lineitem)"


@query("impute_mice_one", f"""
    WITH s AS (SELECT AVG(qty) mq, stddev_samp(qty) sq, AVG(price) mp, stddev_samp(price) sp FROM {_ONE}),
    u AS (SELECT *, (qty - mq) / sq AS y, (price - mp) / sp AS x FROM {_ONE}, s),
    g AS (SELECT COUNT(*)::DOUBLE n, SUM(x) b, SUM(x * x) c, SUM(y) d, SUM(x * y) e FROM u WHERE qty IS NOT NULL),
    r AS (SELECT *, n + 1e-6 * (n + c) / 2 AS a1, c + 1e-6 * (n + c) / 2 AS c1 FROM g),
    w AS (SELECT (c1 * d - b * e) / (a1 * c1 - b * b) AS base, (a1 * e - b * d) / (a1 * c1 - b * b) AS slope FROM r)
    SELECT l_orderkey, l_linenumber, ROUND(COALESCE(qty, (base + slope * x) * sq + mq), 6) AS qty FROM u, w""")
def impute_mice_one(t):
    data = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty",
                                 "l_extendedprice AS price")
    out = clean_rules(data, [{"action_type": "impute", "columns": ["qty", "price"], "impute_method": "mice"}]).df
    return _rounded(out.select("l_orderkey", "l_linenumber", "qty"), qty=6)
