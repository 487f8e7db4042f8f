"""Declarative procedures, quality gates, versions and step lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.cleaning import _GAPPY, gappy
from millrace.catalog.registry import query
from millrace.operators.aggregates import drop_duplicates
from millrace.operators.filters import sql_predicate
from millrace.operators.impute import fill_constants, fill_value
from millrace.plans import quality, trace
from millrace.plans.procedure import (
    Procedure, ProcedureError, bind_parameters, build, build_checked, execution_order, lineage_table, run_golden_tests,
    run_procedure,
)
from millrace.plans.sqltext import procedure_sql
from millrace.plans.transform import run_steps
from millrace.plans.versions import ProcedureStore
from millrace.session import scratch_path
from millrace.sources.snapshots import Snapshots


def _node(node_id, kind, inputs=(), **config):
    return {"id": node_id, "type": kind, "inputs": list(inputs), "config": config}


def reconcile(threshold=100000.0):
    """Filter, dedupe, join, derive, gate and aggregate orders."""
    return Procedure(
        "reconcile_orders",
        [
            _node("orders", "source", dataset_name="orders"),
            _node("customers", "source", dataset_name="customer"),
            _node("names", "clean_names", ["orders"]),
            _node("once", "dedupe", ["names"], subset=["o_orderkey"]),
            _node("large", "filter", ["once"], rules=[{"col": "o_totalprice", "op": ">=", "param": "floor"},
                                                      {"col": "o_orderstatus", "op": "IN", "val": ["O", "F"]}]),
            _node("tax", "compute", ["large"], derived_column="tax", sql_expression="o_totalprice * 0.2"),
            _node("who", "join", ["tax", "customers"], join_type="inner", left_on="o_custkey", right_on="c_custkey"),
            _node("gate", "assertion_gate", ["who"], assertions=[
                {"type": "not_null", "column": "tax"}, {"type": "unique", "column": "o_orderkey"},
                {"type": "range", "column": "o_totalprice", "min": 0, "max": 1e9},
                {"type": "accepted_values", "column": "o_orderstatus", "values": ["O", "F"]},
                {"type": "row_count", "min_rows": 1},
                {"type": "referential", "column": "c_nationkey", "parent": "nation", "parent_column": "n_nationkey"}]),
            _node("sums", "aggregate", ["gate"], group_by=["c_mktsegment"], metrics=[
                {"agg": "sum", "col": "tax", "alias": "tax"}, {"agg": "count", "col": "*", "alias": "n"}]),
            _node("out", "output", ["sums"]),
        ],
        parameters=[{"name": "floor", "type": "float", "default": threshold, "min_value": 0}],
        golden_tests=[{"name": "segments", "params": {"floor": "0"}, "expected_columns": ["c_mktsegment", "tax", "n"]}],
    )


def _inputs(t):
    return {"orders": t.orders.unionByName(t.orders.where("o_orderkey % 10 = 0")), "customer": t.customer, "nation": t.nation}


_BIG = """(SELECT * FROM (SELECT DISTINCT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) = 1)
          WHERE o_totalprice >= 100000 AND o_orderstatus IN ('O', 'F'))"""
_SUMS = f"""SELECT c_mktsegment, ROUND(SUM(o_totalprice * 0.2), 2) AS tax, COUNT(*) AS n FROM {_BIG} JOIN customer ON o_custkey = c_custkey GROUP BY 1"""


def _tidy(df):
    return df.withColumn("tax", F.round("tax", 2))


@query("proc_run", _SUMS)
def proc_run(t):
    return _tidy(run_procedure(reconcile(), _inputs(t)).df)


@query("proc_output", _SUMS)
def proc_output(t):
    return _tidy(build(reconcile(), _inputs(t), {"floor": "100000"}))


@query("proc_dry_run", f"SELECT COUNT(*) AS n, 0::BIGINT AS versions FROM ({_SUMS})")
def proc_dry_run(t):
    store = Snapshots(t.spark, scratch_path(t.spark, "dry"))
    result = run_procedure(reconcile(), _inputs(t), dry_run=True, snapshots=store)
    return result.df.agg(F.lit(result.rows_out).cast("bigint").alias("n"), F.lit(len(store.manifest())).cast("bigint").alias("versions"))


@query("win_lineage_prev", f"""
    WITH a AS (SELECT (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM orders WHERE o_orderkey % 10 = 0) AS loaded,
      (SELECT COUNT(DISTINCT o_orderkey) FROM orders) AS once, (SELECT COUNT(*) FROM {_BIG}) AS big)
    SELECT 'once' AS node_id, once AS rows_out, loaded - once AS dropped_count FROM a UNION ALL SELECT 'large', big, once - big FROM a""")
def win_lineage_prev(t):
    result = run_procedure(reconcile(), _inputs(t))
    table = lineage_table(t.orders, result.lineage)
    return table.where("node_id IN ('once', 'large')").select("node_id", "rows_out", "dropped_count")


@query("lineage_flags", "SELECT o_orderkey, 'large' AS dropped_by FROM orders WHERE NOT (o_totalprice >= 100000 AND o_orderstatus IN ('O', 'F'))")
def lineage_flags(t):
    traced = trace.trace_drops(reconcile(), _inputs(t), source="orders")
    return trace.dropped(traced).where("dropped_by = 'large'").select("o_orderkey", "dropped_by")


@query("lineage_reasons", f"""
    SELECT 'once' AS dropped_by, 'repeats a key' AS reason, COUNT(*) AS n_rows FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'large', 'does not match the filter', (SELECT COUNT(*) FROM orders) - COUNT(*) FROM {_BIG}""")
def lineage_reasons(t):
    return trace.drop_counts(trace.trace_drops(reconcile(), _inputs(t), source="orders"))


@query("proc_source", "SELECT COUNT(*) AS n FROM region")
def proc_source(t):
    one = Procedure("p", [_node("s", "source", dataset_name="absent"), _node("o", "output")])
    return build(one, {"default": t.region, "other": t.nation}).agg(F.count(F.lit(1)).alias("n"))


_GRAPH = """(SELECT 'r' || r_regionkey AS node, 0 AS depth, r_regionkey AS k FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, n_nationkey FROM nation)"""


@query("proc_validate", f"""
    SELECT 'order' AS kind, node, CAST(row_number() OVER (ORDER BY depth, k) AS INTEGER) AS place FROM {_GRAPH}
    UNION ALL SELECT kind, 'n' || n_nationkey, NULL FROM nation, (SELECT unnest(['cycle', 'unknown', 'repeated']) AS kind)""")
def proc_validate(t):
    """A graph of regions and their nations in order; the same graph broken at each nation in three ways is refused."""
    regions = [f"r{r.r_regionkey}" for r in t.region.orderBy("r_regionkey").collect()]
    nations = {f"n{r.n_nationkey}": f"r{r.n_regionkey}" for r in t.nation.orderBy("n_nationkey").collect()}
    graph = [_node(n, "output", [r]) for n, r in nations.items()] + [_node(r, "source") for r in regions]
    ordered = [n["id"] for n in execution_order(graph)]
    rows = [("order", node, place) for place, node in enumerate(ordered, 1)]
    for nation, region in nations.items():
        broken = {"cycle": [_node(n["id"], n["type"], [nation]) if n["id"] == region else n for n in graph],
                  "unknown": [_node(n["id"], n["type"], ["zz"]) if n["id"] == nation else n for n in graph],
                  "repeated": [*graph, _node(nation, "source")]}
        for kind, nodes in broken.items():
            try:
                execution_order(nodes)
            except ValueError:
                rows.append((kind, nation, None))
    return t.spark.createDataFrame(rows, "kind string, node string, place int")


@query("proc_filter", f"""
    SELECT l_orderkey, l_linenumber, l_partkey FROM {_GAPPY} WHERE qty <> 10 AND flag ILIKE 'r' AND price IS NOT NULL AND l_linenumber NOT IN (2, 3) AND qty < 40""")
def proc_filter(t):
    data = gappy(t)
    bound = bind_parameters([{"name": "top", "type": "int", "default": "40"}])
    for name, op, value in (("qty", "<>", 10), ("flag", "ILIKE", "r"), ("price", "IS NOT NULL", None),
                            ("l_linenumber", "NOT IN", [2, 3]), ("qty", "<", bound["top"])):
        data = data.where(sql_predicate(data, name, op, value))
    return data.select("l_orderkey", "l_linenumber", "l_partkey")


@query("param_bind", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice >= 250.5 AND o_orderstatus = 'O' GROUP BY 1")
def param_bind(t):
    params = bind_parameters(
        [{"name": "floor", "type": "float", "default": 100, "min_value": 0},
         {"name": "status", "type": "enum", "allowed_values": ["O", "F"], "required": True}],
        {"floor": "250.5", "status": "O"})
    t.orders.createOrReplaceTempView("param_orders")
    return t.spark.sql("SELECT o_orderstatus, COUNT(*) AS n FROM param_orders WHERE o_totalprice >= :floor "
                       "AND o_orderstatus = :status GROUP BY o_orderstatus", args=params)


@query("impute_node", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(qty, (SELECT median(qty) FROM {_GAPPY})) AS qty, COALESCE(tax, 0) AS tax, COALESCE(flag, 'X') AS flag FROM {_GAPPY}""")
def impute_node(t):
    p = Procedure("fill", [_node("s", "source"), _node("f", "impute", ["s"], columns={
        "qty": {"strategy": "median"}, "tax": {"strategy": "zero"}, "flag": {"strategy": "constant", "value": "X"}})])
    return build(p, {"default": gappy(t)}).select("l_orderkey", "l_linenumber", "l_partkey", "qty", "tax", "flag")


@query("win_median_over", f"SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(qty, median(qty) OVER ()) AS qty FROM {_GAPPY}")
def win_median_over(t):
    data = gappy(t)
    return fill_constants(data, fill_value(data, ["qty"], "median")).select("l_orderkey", "l_linenumber", "l_partkey", "qty")


@query("proc_union", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def proc_union(t):
    p = Procedure("u", [_node("a", "source"), _node("b", "filter", ["a"], rules=[{"col": "o_orderstatus", "val": "F"}]),
                        _node("c", "union", ["a", "b"]), _node("d", "cast", ["c"], casts={"o_orderkey": "varchar"})])
    return build(p, {"default": t.orders}).agg(F.count("o_orderkey").alias("n"))


@query("recode_pipeline", _SUMS)
def recode_sql(t):
    inputs = _inputs(t)
    for name, df in inputs.items():
        df.createOrReplaceTempView(name)
    return _tidy(t.spark.sql(procedure_sql(reconcile(), inputs)))


@query("proc_version", "SELECT '1.0.0' AS version, COUNT(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT '1.1.0', COUNT(*) FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'rolled back', COUNT(*) FROM orders WHERE o_totalprice > 400000")
def proc_version(t):
    store = ProcedureStore(t.spark, scratch_path(t.spark, "procedures"))

    def above(value, tag):
        return Procedure("big", [_node("s", "source"), _node("f", "filter", ["s"], rules=[
            {"col": "o_totalprice", "op": ">", "val": value}])], version=tag)

    inputs, rows = {"default": t.orders}, []
    store.publish(above(400000, "1.0.0"))
    store.publish(above(200000, "1.1.0"), "lower floor")
    rows.append(("1.0.0", store.run("big", inputs, tag="1.0.0")["rows_out"]))
    rows.append(("1.1.0", store.run("big", inputs, key="nightly")["rows_out"]))
    store.rollback("big", "1.0.0")
    assert store.run("big", inputs, key="nightly")["rows_out"] == rows[-1][1]
    rows.append(("rolled back", store.run("big", inputs, key="nightly", force=True)["rows_out"]))
    return t.spark.createDataFrame(rows, "version string, n long")


@query("golden_tests", f"""
    SELECT 'segments' AS name, COUNT(*) = 5 AND SUM(n) BETWEEN 1 AND (SELECT COUNT(*) FROM orders) AS passed, COUNT(*) AS n_rows,
           SUM(n)::DOUBLE AS orders, ROUND(MAX(tax), 2) AS top_tax FROM ({_SUMS})""")
def golden_tests(t):
    given = _inputs(t)
    case = {"name": "segments", "params": {"floor": "100000"}, "expected_columns": ["c_mktsegment", "tax", "n"], "expected_row_count": 5,
            "expected_aggregates": {"sum(n)": t.orders.where("o_totalprice >= 100000 AND o_orderstatus IN ('O', 'F')").count(),
                                    "max(tax)": build(reconcile(), given).agg(F.max("tax")).first()[0]}}
    plan = reconcile()
    plan.golden_tests = [case]
    rows = [(r["name"], r["passed"], r["rows"], r["aggregates"]["sum(n)"], round(r["aggregates"]["max(tax)"], 2))
            for r in run_golden_tests(plan, given)]
    return t.spark.createDataFrame(rows, "name string, passed boolean, n_rows long, orders double, top_tax double")


# ---- quality

def _verdicts(df, checks, parents=None):
    found = quality.run_checks(df, checks, parents)
    return quality.verdict_table(df, found).select("type", "column", "passed", "failing")


@query("dq_not_null", f"""SELECT 'not_null' AS type, 'qty' AS "column", FALSE AS passed, COUNT(*) FILTER (qty IS NULL) AS failing FROM {_GAPPY}
    UNION ALL SELECT 'not_null', 'l_partkey', TRUE, COUNT(*) FILTER (l_partkey IS NULL) FROM {_GAPPY}""")
def dq_not_null(t):
    return _verdicts(gappy(t), [{"type": "not_null", "column": "qty"}, {"type": "not_null", "column": "l_partkey"}])


@query("dq_unique", """SELECT 'unique' AS type, 'o_custkey' AS "column", FALSE AS passed, COUNT(*) AS failing FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1)
    UNION ALL SELECT 'unique', 'o_orderkey', COUNT(*) = 0, COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1)""")
def dq_unique(t):
    return _verdicts(t.orders, [{"type": "unique", "column": "o_custkey"}, {"type": "unique", "column": "o_orderkey"}])


@query("dq_range", f"""SELECT 'range' AS type, 'qty' AS "column", FALSE AS passed, COUNT(*) FILTER (qty < 5 OR qty > 45) AS failing FROM {_GAPPY}""")
def dq_range(t):
    return _verdicts(gappy(t), [{"type": "range", "column": "qty", "min": 5, "max": 45}])


@query("dq_accepted", f"""SELECT 'accepted_values' AS type, 'flag' AS "column", FALSE AS passed, COUNT(*) FILTER (flag NOT IN ('A', 'N')) AS failing FROM {_GAPPY}""")
def dq_accepted(t):
    return _verdicts(gappy(t), [{"type": "accepted_values", "column": "flag", "values": ["A", "N"]}])


@query("dq_row_count", "SELECT 'row_count' AS type, COUNT(*) >= 10 AS passed FROM part UNION ALL SELECT 'row_count', COUNT(*) <= 10 FROM part")
def dq_row_count(t):
    return _verdicts(t.part, [{"type": "row_count", "min_rows": 10}, {"type": "row_count", "max_rows": 10}]).select("type", "passed")


@query("dq_referential", """SELECT 'referential' AS type, 'o_custkey' AS "column", FALSE AS passed, COUNT(*) AS failing FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dq_referential(t):
    return _verdicts(t.orders, [{"type": "referential", "column": "o_custkey", "parent": "rich", "parent_column": "c_custkey"}],
                     {"rich": t.customer.where("c_acctbal > 0")})


@query("dq_column_exists", "SELECT 'not_null' AS type, 'absent' AS \"column\", COUNT(*) < 0 AS passed, 0::BIGINT AS failing FROM part")
def dq_column_exists(t):
    return _verdicts(t.part, [{"type": "not_null", "column": "absent"}])


@query("dq_gate", f"SELECT 'error' AS severity, TRUE AS stopped, COUNT(*) FILTER (qty IS NULL) AS failing FROM {_GAPPY} UNION ALL SELECT 'warn', FALSE, COUNT(*) FILTER (qty IS NULL) FROM {_GAPPY}")
def dq_gate(t):
    rows = []
    for severity in ("error", "warn"):
        checks = [{"type": "not_null", "column": "qty", "severity": severity}]
        p = Procedure("g", [_node("s", "source"), _node("g", "assertion_gate", ["s"], assertions=checks)])
        try:
            rows.append((severity, False, build_checked(p, {"default": gappy(t)})[1][0].failing))
        except ProcedureError as stopped:
            rows.append((severity, True, stopped.details[0].failing))
    return t.spark.createDataFrame(rows, "severity string, stopped boolean, failing long")


@query("dq_score", f"""
    SELECT 'not_null_threshold' AS rule, ROUND(COUNT(*) FILTER (qty IS NULL) * 100.0 / COUNT(*), 2) AS observed, 'FAILED' AS status FROM {_GAPPY}
    UNION ALL SELECT 'uniqueness_check', (COUNT(*) - COUNT(DISTINCT l_partkey))::DOUBLE, 'WARNING' FROM {_GAPPY}
    UNION ALL SELECT 'range_check', COUNT(*) FILTER (price < 0)::DOUBLE, 'PASSED' FROM {_GAPPY}""")
def dq_score(t):
    found = quality.score_checks(gappy(t), [
        {"type": "not_null_threshold", "column": "qty", "max_null_pct": 5.0}, {"type": "uniqueness_check", "column": "l_partkey"},
        {"type": "range_check", "column": "price", "min": 0}])
    assert found["score"] == 33.3 and found["overall"] == "WARNING"
    return t.spark.createDataFrame([(c["rule"], c["observed"], c["status"]) for c in found["checks"]],
                                   "rule string, observed double, status string")


# ---- step lists

@query("transform_steps", """
    SELECT c_mktsegment AS segment, ROUND(SUM(c_acctbal * 2), 2) AS doubled FROM customer WHERE c_acctbal > 0 AND regexp_matches(c_mktsegment, '(?i)r') GROUP BY 1""")
def transform_steps(t):
    out = run_steps(t.customer, [
        {"op": "filter", "rules": [{"col": "c_acctbal", "op": ">", "val": 0}, {"col": "c_mktsegment", "op": "contains", "val": "r"}]},
        {"op": "create", "name": "doubled", "formula": "c_acctbal * 2"},
        {"op": "groupby", "group": ["c_mktsegment"], "agg": {"doubled": "sum", "c_custkey": "count"}},
        {"op": "rename", "map": {"c_mktsegment": "segment"}}, {"op": "drop_cols", "cols": ["c_custkey"]},
        {"op": "sort", "by": "doubled"}])
    return out.withColumn("doubled", F.round("doubled", 2))


@query("dedupe_step", "SELECT o_orderstatus, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedupe_step(t):
    return drop_duplicates(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"])
