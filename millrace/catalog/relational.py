"""Joins, filters, projections, sorts, set operations and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import aggregates, filters, joins, shape
from millrace.operators.joins import JoinSpec
from millrace.operators.ordered import number_rows
from millrace.sources.workspace import Workspace

_ORDERS_BY_CUSTOMER = {
    "table": "orders",
    "group_by": ["o_custkey"],
    "aggregates": [
        {"column": "o_totalprice", "function": "SUM", "alias": "revenue"},
        {"column": "o_orderkey", "function": "COUNT", "alias": "n_orders"},
    ],
}


def _on(left_table, left, right):
    return [{"left_table": left_table, "left_col": left, "right_col": right}]


@query("flagship_segment_revenue", """
    WITH r AS (SELECT o_custkey, SUM(o_totalprice) revenue, COUNT(o_orderkey) n_orders
               FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, ROUND(SUM(revenue), 2) AS revenue, CAST(SUM(n_orders) AS BIGINT) AS n_orders
    FROM customer JOIN r ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def flagship(t):
    joined = joins.run_join(
        {"customer": t.customer, "orders": t.orders},
        JoinSpec("customer",
                 [{"table": "orders", "join_type": "INNER", "conditions": _on("customer", "c_custkey", "o_custkey"),
                   "rollup": _ORDERS_BY_CUSTOMER}],
                 columns=["c_mktsegment", "revenue", "n_orders"]),
    )
    table = aggregates.group_aggregate(joined, ["c_mktsegment"], {"revenue": "sum", "n_orders": "sum"})
    return shape.sort_rows(table.withColumn("revenue", F.round("revenue", 2)), "revenue")


# ---- joins

@query("join_inner", """
    SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_inner(t):
    return joins.run_join(
        {"orders": t.orders, "customer": t.customer, "nation": t.nation},
        JoinSpec("orders",
                 [{"table": "customer", "join_type": "INNER", "conditions": _on("orders", "o_custkey", "c_custkey")},
                  {"table": "nation", "join_type": "INNER", "conditions": _on("customer", "c_nationkey", "n_nationkey")}],
                 columns=["o_orderkey", "o_totalprice", "c_name", "n_name"]))


# every second customer has no order, and orders of the second half have no customer
_SPREAD = "(SELECT * REPLACE (o_custkey * 2 AS o_custkey) FROM orders)"


def _spread(t):
    return t.orders.withColumn("o_custkey", F.col("o_custkey") * 2)


def _one_join(t, how, columns):
    return joins.run_join(
        {"customer": t.customer, "orders": _spread(t)},
        JoinSpec("customer", [{"table": "orders", "join_type": how,
                               "conditions": _on("customer", "c_custkey", "o_custkey")}], columns=columns))


_PAIR = ["c_custkey", "c_name", "o_orderkey", "o_totalprice"]


@query("join_left", f"""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
    LEFT JOIN {_SPREAD} ON c_custkey = o_custkey""")
def join_left(t):
    return _one_join(t, "LEFT", _PAIR)


@query("join_default", f"""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
    LEFT JOIN {_SPREAD} ON c_custkey = o_custkey""")
def join_default(t):
    return _one_join(t, "LOOKUP", _PAIR)


@query("join_right", f"""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
    RIGHT JOIN {_SPREAD} ON c_custkey = o_custkey""")
def join_right(t):
    return joins.run_join(
        {"customer": t.customer, "orders": _spread(t)},
        JoinSpec("customer", [{"table": "orders", "join_type": "RIGHT",
                               "conditions": _on("customer", "c_custkey", "o_custkey")}], columns=_PAIR))


@query("join_full", f"""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer
    FULL JOIN {_SPREAD} ON c_custkey = o_custkey""")
def join_full(t):
    return joins.run_join(
        {"customer": t.customer, "orders": _spread(t)},
        JoinSpec("customer", [{"table": "orders", "join_type": "FULL",
                               "conditions": _on("customer", "c_custkey", "o_custkey")}], columns=_PAIR))


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.run_join({"region": t.region, "nation": t.nation},
                          JoinSpec("region", [{"table": "nation", "join_type": "CROSS"}], columns=["r_name", "n_name"]))


@query("join_semi", """
    SELECT * FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000)
    ON c_custkey = o_custkey""")
def join_semi(t):
    return joins.run_join(
        {"customer": t.customer, "orders": t.orders},
        JoinSpec("customer", [{"table": "orders", "join_type": "SEMI",
                               "conditions": _on("customer", "c_custkey", "o_custkey")}],
                 filters=[{"table": "orders", "column": "o_totalprice", "operator": ">", "value": "400000"}]))


@query("join_anti", """
    SELECT * FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000)
    ON c_custkey = o_custkey""")
def join_anti(t):
    return joins.run_join(
        {"customer": t.customer, "orders": t.orders},
        JoinSpec("customer", [{"table": "orders", "join_type": "ANTI",
                               "conditions": _on("customer", "c_custkey", "o_custkey")}],
                 filters=[{"table": "orders", "column": "o_totalprice", "operator": ">", "value": "400000"}]))


@query("join_collision", """
    SELECT a.n_name AS home_n_name, b.n_name AS ship_n_name, a.n_nationkey AS home_n_nationkey,
           b.n_nationkey AS ship_n_nationkey, s_name
    FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey""")
def join_collision(t):
    return joins.run_join(
        {"supplier": t.supplier, "home": t.nation, "ship": t.nation},
        JoinSpec("supplier",
                 [{"table": "home", "join_type": "INNER", "conditions": _on("supplier", "s_nationkey", "n_nationkey")},
                  {"table": "ship", "join_type": "INNER", "conditions": _on("supplier", "s_nationkey", "n_nationkey")}],
                 columns=["s_name", "n_name", "n_nationkey"]))


@query("join_multi_key", """
    SELECT a.l_orderkey, a.l_partkey, a.l_quantity, b.n_lines
    FROM lineitem a JOIN (SELECT l_orderkey, l_partkey, COUNT(l_linenumber) AS n_lines FROM lineitem
                          GROUP BY l_orderkey, l_partkey) b
    ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey""")
def join_multi_key(t):
    lines = t.lineitem
    out = joins.run_join(
        {"lineitem": lines.select("l_orderkey", "l_partkey", "l_quantity"), "pairs": lines},
        JoinSpec("lineitem",
                 [{"table": "pairs", "join_type": "INNER",
                   "conditions": [{"left_col": k, "right_col": k} for k in ("l_orderkey", "l_partkey")],
                   "rollup": {"table": "pairs", "group_by": ["l_orderkey", "l_partkey"],
                              "aggregates": [{"column": "l_linenumber", "function": "COUNT", "alias": "n_lines"}]}}],
                 columns=["lineitem_l_orderkey", "lineitem_l_partkey", "l_quantity", "n_lines"]))
    return shape.rename(out, {"lineitem_l_orderkey": "l_orderkey", "lineitem_l_partkey": "l_partkey"})


@query("join_rollup", """
    SELECT o_custkey, COUNT(o_orderkey) AS orders_count_o_orderkey, ROUND(SUM(o_totalprice), 2) AS total,
           ROUND(AVG(o_totalprice), 6) AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high,
           COUNT(DISTINCT o_orderpriority) AS n_priorities
    FROM orders GROUP BY o_custkey""")
def join_rollup(t):
    spec = {"table": "orders", "group_by": ["o_custkey"], "aggregates": [
        {"column": "o_orderkey", "function": "COUNT"},
        {"column": "o_totalprice", "function": "SUM", "alias": "total"},
        {"column": "o_totalprice", "function": "AVG", "alias": "mean"},
        {"column": "o_totalprice", "function": "MIN", "alias": "low"},
        {"column": "o_totalprice", "function": "MAX", "alias": "high"},
        {"column": "o_orderpriority", "function": "COUNT_DISTINCT", "alias": "n_priorities"}]}
    out = joins.rollup(t.orders, "orders", spec)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("count_distinct", "SELECT COUNT(DISTINCT l_partkey) AS lineitem_count_distinct_l_partkey FROM lineitem")
def count_distinct(t):
    return joins.rollup(t.lineitem, "lineitem",
                        {"aggregates": [{"column": "l_partkey", "function": "COUNT_DISTINCT"}]})


@query("join_filter", """
    SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_acctbal >= 1000 AND n_name ILIKE '%nation_1%' AND c_mktsegment IN ('BUILDING', 'MACHINERY')
      AND c_name IS NOT NULL AND c_mktsegment ILIKE 'b%' AND c_name ILIKE '%7'""")
def join_filter(t):
    return joins.run_join(
        {"customer": t.customer, "nation": t.nation},
        JoinSpec("customer",
                 [{"table": "nation", "join_type": "INNER", "conditions": _on("customer", "c_nationkey", "n_nationkey")}],
                 columns=["c_custkey", "c_name", "c_mktsegment", "n_name"],
                 filters=[
                     {"table": "customer", "column": "c_acctbal", "operator": ">=", "value": "1000"},
                     {"table": "nation", "column": "n_name", "operator": "CONTAINS", "value": "nation_1"},
                     {"table": "customer", "column": "c_mktsegment", "operator": "IN", "value": "BUILDING, MACHINERY"},
                     {"table": "customer", "column": "c_name", "operator": "IS_NOT_NULL"},
                     {"table": "customer", "column": "c_mktsegment", "operator": "STARTS_WITH", "value": "b"},
                     {"table": "customer", "column": "c_name", "operator": "ENDS_WITH", "value": "7"}]))


@query("join_preview", """
    SELECT COUNT(*) AS total_rows, LEAST(COUNT(*), 50) AS shown_rows FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_preview(t):
    rows, total = joins.preview_join(
        {"orders": t.orders, "customer": t.customer},
        JoinSpec("orders", [{"table": "customer", "join_type": "INNER",
                             "conditions": _on("orders", "o_custkey", "c_custkey")}]), 50)
    return rows.agg(F.lit(total).alias("total_rows"), F.count(F.lit(1)).alias("shown_rows"))


@query("proc_join", """
    SELECT l.*, r.* EXCLUDE (c_custkey) FROM orders l INNER JOIN customer r ON l.o_custkey = r.c_custkey""")
def proc_join(t):
    return joins.join_two(t.orders, t.customer, "o_custkey", "c_custkey", "inner")


# ---- filters

_PARTLY = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END"


@query("filter_cmp", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem
    WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.02 AND l_discount <= 0.08
      AND l_linenumber != 3 AND l_returnflag = 'R'""")
def filter_cmp(t):
    out = filters.filter_rules(t.lineitem, [
        {"col": "l_quantity", "op": ">=", "val": "10"}, {"col": "l_quantity", "op": "<", "val": 40},
        {"col": "l_discount", "op": ">", "val": 0.02}, {"col": "l_discount", "op": "<=", "val": "0.08"},
        {"col": "l_linenumber", "op": "!=", "val": 3}, {"col": "l_returnflag", "op": "==", "val": "R"}])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("filter_text", """
    SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, '(?i)RED|blue')
      AND NOT regexp_matches(p_name, '(?i)WIDGET') AND p_brand LIKE 'Brand#1%' AND NOT suffix(p_name, 'zzz')
      AND suffix(p_brand, '7')""")
def filter_text(t):
    out = filters.filter_rules(t.part, [
        {"col": "p_name", "op": "contains", "val": "RED|blue"},
        {"col": "p_name", "op": "not_contains", "val": "WIDGET"},
        {"col": "p_brand", "op": "startswith", "val": "Brand#1"},
        {"col": "p_brand", "op": "endswith", "val": "7"}])
    return out.select("p_partkey", "p_name", "p_brand")


@query("filter_in", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def filter_in(t):
    out = filters.filter_rules(t.orders, [
        {"col": "o_orderstatus", "op": "in", "val": "O,P"},
        {"col": "o_orderpriority", "op": "not_in", "val": ["1-URGENT", "5-LOW"]}])
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("filter_null", f"""
    SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, {_PARTLY} AS qty FROM lineitem)
    WHERE qty IS NULL AND l_discount IS NOT NULL""")
def filter_null(t):
    data = t.lineitem.withColumn("qty", F.expr(_PARTLY))
    out = filters.filter_rules(data, [{"col": "qty", "op": "is_null"}, {"col": "l_discount", "op": "not_null"}])
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query("filter_logic", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, qty FROM (SELECT *, {_PARTLY} AS qty FROM lineitem)
    WHERE ((COALESCE(qty > 45, FALSE)) OR l_returnflag = 'A') AND COALESCE(qty <> 50, TRUE)""")
def filter_logic(t):
    data = t.lineitem.withColumn("qty", F.expr(_PARTLY))
    out = filters.filter_rules(data, [
        {"col": "qty", "op": ">", "val": 45}, {"col": "l_returnflag", "op": "==", "val": "A", "logic": "OR"},
        {"col": "qty", "op": "!=", "val": 50, "logic": "AND"}])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "qty")


@query("dash_filter", """
    SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""")
def dash_filter(t):
    return filters.equal_filters(t.orders, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "nope": 1})


@query("drilldown", """
    SELECT 'bar' AS chart, COUNT(*) AS total_matches FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'dist', COUNT(*) FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20.5""")
def drilldown(t):
    bar = filters.drilldown(t.customer, "c_mktsegment", "BUILDING")
    dist = filters.drilldown(t.lineitem, "l_quantity", "10-20.5", "dist")
    return (bar.agg(F.lit("bar").alias("chart"), F.count(F.lit(1)).alias("total_matches"))
            .unionByName(dist.agg(F.lit("dist").alias("chart"), F.count(F.lit(1)).alias("total_matches"))))


@query("drilldown_rows", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 100")
def drilldown_rows(t):
    return filters.drilldown(t.customer, "c_mktsegment", "BUILDING").orderBy("c_custkey").limit(100)


@query("nl_filter_plan", "SELECT * FROM orders WHERE o_totalprice > 450000 ORDER BY o_orderkey LIMIT 100")
def nl_filter_plan(t):
    return filters.numeric_or_text_compare(t.orders, "o_totalprice", ">", 450000).orderBy("o_orderkey").limit(100)


@query("global_search", """
    SELECT * FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), 'lt') OR contains(lower(p_name), 'lt')
       OR contains(lower(p_brand), 'lt') OR contains(lower(p_type), 'lt')""")
def global_search(t):
    return filters.global_search(t.part, "LT")


@query("page", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 75 LIMIT 25")
def page(t):
    return shape.page(t.customer, [F.desc("c_acctbal"), F.col("c_custkey")], 3, 25)


# ---- projection, names

@query("preview", "SELECT o_orderkey, o_orderstatus, 15000 * 0 + (SELECT COUNT(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 200")
def preview(t):
    shown = shape.preview(t.orders.orderBy("o_orderkey"), 200, ["o_orderkey", "o_orderstatus", "absent"])
    return shown.rows.withColumn("total_rows", F.lit(shown.total))


@query("sql_custom", """
    SELECT n_name, COUNT(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def sql_custom(t):
    ws = Workspace(t.spark)
    ws.register_all({"customer": t.customer, "nation": t.nation})
    return ws.sql("SELECT n_name, COUNT(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey "
                  "GROUP BY n_name;", limit=500)


@query("grouping_sets", """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem
    GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouping_sets(t):
    ws = Workspace(t.spark)
    ws.register("lineitem", t.lineitem)
    return ws.sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty "
                  "FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")


@query("rename", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def rename(t):
    return shape.rename(t.nation, {"n_nationkey": "nation_id", "n_name": "nation", "zzz": "y"})


@query("drop_cols", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_cols(t):
    return shape.drop_columns(t.customer, ["c_nationkey", "c_acctbal", "absent"])


@query("clean_names", """
    SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS acct_bal_usd, c_mktsegment AS full_name_2,
           c_nationkey AS html_page FROM customer""")
def clean_names(t):
    odd = t.customer.toDF("Customer ID", "FullName", "HTMLPage", "Acct-Bal (USD)", "full name")
    return shape.clean_names(odd)


# ---- sort, top, sample

@query("sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC NULLS LAST")
def sort(t):
    return shape.sort_rows(t.orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("sort_natural", """
    SELECT row_number() OVER (ORDER BY try_cast(size_text AS DOUBLE) NULLS LAST, size_text, p_partkey) AS pos,
           p_partkey, size_text FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text FROM part)""")
def sort_natural(t):
    texts = t.part.select("p_partkey", F.col("p_size").cast("string").alias("size_text"))
    # numbers first, texts that are none last, as natural_keys orders them
    sized = texts.withColumn("_n", F.col("size_text").try_cast("double")).withColumn("_none", F.col("_n").isNull())
    return number_rows(sized, ["_none", "_n", "size_text", "p_partkey"], name="pos").drop("_n", "_none")


@query("topn_group", """
    SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def topn_group(t):
    top = shape.top_groups(t.customer, "c_mktsegment", "c_acctbal", "mean", 3)
    return top.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("topn_values", """
    SELECT * FROM (SELECT 'frequent' AS kind, p_name AS label, CAST(COUNT(*) AS DOUBLE) AS amount FROM part GROUP BY p_name
                   ORDER BY 3 DESC, 2 LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'largest', NULL, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10)""")
def topn_values(t):
    frequent = shape.top_frequent(t.part, "p_name", 5).select(
        F.lit("frequent").alias("kind"), F.col("p_name").alias("label"), F.col("count").cast("double").alias("amount"))
    largest = shape.top_values(t.orders, "o_totalprice", 10).select(
        F.lit("largest").alias("kind"), F.lit(None).cast("string").alias("label"),
        F.col("o_totalprice").alias("amount"))
    return frequent.unionByName(largest)


@query("tail5", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def tail5(t):
    return shape.last_rows(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], 5, ["value"])


@query("sample_n", "SELECT * FROM orders ORDER BY md5(concat_ws('|', o_orderkey, 42)), o_orderkey LIMIT 500")
def sample_n(t):
    return shape.sample_rows(t.orders, ["o_orderkey"], 500)


@query("sample_stratified", """
    WITH c AS (SELECT event_type, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM events GROUP BY 1)
    SELECT event_type, CASE WHEN total <= 2000 THEN n ELSE round_even(n * 2000 / total::DOUBLE, 0)::BIGINT END AS n FROM c""")
def sample_stratified(t):
    return (shape.sample_stratified(t.events, "event_type", ["event_id"], 2000)
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


# ---- sets

@query("union", """
    SELECT c_custkey AS key, c_name AS name, NULL AS size FROM customer
    UNION ALL SELECT p_partkey, p_name, p_size FROM part""")
def union(t):
    people = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    goods = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return shape.union_all([people, goods])


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(t):
    return aggregates.drop_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


# ---- aggregation

@query("groupby_agg", """
    SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS l_quantity, ROUND(AVG(l_extendedprice), 4) AS l_extendedprice,
           median(l_discount) AS l_discount, ROUND(stddev_samp(l_tax), 6) AS l_tax, MIN(l_shipdate) AS l_shipdate,
           MAX(l_linenumber) AS l_linenumber, COUNT(l_orderkey) AS l_orderkey, COUNT(DISTINCT l_partkey) AS l_partkey
    FROM lineitem GROUP BY l_returnflag""")
def groupby_agg(t):
    out = aggregates.group_aggregate(t.lineitem, ["l_returnflag"], {
        "l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "median", "l_tax": "std",
        "l_shipdate": "min", "l_linenumber": "max", "l_orderkey": "count", "l_partkey": "nunique"})
    return out.withColumns({"l_quantity": F.round("l_quantity", 2), "l_tax": F.round("l_tax", 6),
                            "l_extendedprice": F.round("l_extendedprice", 4)})


@query("groupby_first_last", """
    SELECT event_type, arg_min(value, ts) AS value, arg_max(user_id, ts) AS user_id
    FROM events GROUP BY event_type""")
def groupby_first_last(t):
    return aggregates.group_aggregate(
        t.events, ["event_type"], {"value": "first", "user_id": "last"}, ["ts", "event_id"])


@query("groupby_default", """
    SELECT p_brand, CAST(SUM(p_partkey) AS BIGINT) AS p_partkey, CAST(SUM(p_size) AS BIGINT) AS p_size,
           ROUND(SUM(p_retailprice), 2) AS p_retailprice FROM part GROUP BY p_brand""")
def groupby_default(t):
    return aggregates.group_aggregate(t.part, ["p_brand"]).withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("groupby_null_keys", """
    SELECT k, COUNT(o_orderkey) AS o_orderkey, ROUND(var_samp(o_totalprice), 2) AS o_totalprice FROM
      (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS k FROM orders)
    WHERE k IS NOT NULL GROUP BY k""")
def groupby_null_keys(t):
    keyed = t.orders.withColumn("k", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"))
    out = aggregates.group_aggregate(keyed, ["k"], {"o_orderkey": "count", "o_totalprice": "var"})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("proc_aggregate", """
    SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice,
           ROUND(median(o_totalprice), 4) AS mid FROM orders GROUP BY 1, 2""")
def proc_aggregate(t):
    out = aggregates.aggregate_metrics(t.orders, ["o_orderstatus", "o_orderpriority"], [
        {"agg": "count", "col": "*", "alias": "n"}, {"agg": "sum", "col": "o_totalprice"},
        {"agg": "median", "col": "o_totalprice", "alias": "mid"}])
    return out.withColumns({"sum_o_totalprice": F.round("sum_o_totalprice", 2), "mid": F.round("mid", 4)})


@query("dedupe_all", "SELECT DISTINCT * FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0)")
def dedupe_all(t):
    return aggregates.drop_duplicates(t.orders.unionByName(t.orders.where("o_orderkey % 3 = 0")))


_DEDUPE_SQL = """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"""


@query("dedupe_subset", _DEDUPE_SQL)
def dedupe_subset(t):
    out = aggregates.drop_duplicates(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_totalprice")


@query("crosstab", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(t):
    return aggregates.crosstab(t.orders, "o_orderstatus", "o_orderpriority")
