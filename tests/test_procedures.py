"""Procedures, gates, versions and snapshots."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.plans.procedure import (
    Procedure, ProcedureError, bind_parameters, build, execution_order, run_golden_tests, run_procedure,
)
from millrace.plans.quality import run_checks, score_checks
from millrace.plans import trace
from millrace.plans.sqltext import procedure_sql
from millrace.plans.versions import ProcedureStore, StillRunning
from millrace.sources.snapshots import ConflictError, Snapshots, content_id


def node(node_id, kind, inputs=(), **config):
    return {"id": node_id, "type": kind, "inputs": list(inputs), "config": config}


@pytest.fixture
def parcels(spark):
    rows = [(1, "north", 2.0, "road"), (2, "south", 8.5, "rail"), (3, "north", 12.0, "rail"), (3, "north", 12.0, "rail"),
            (4, "west", 0.5, None), (5, "north", 30.0, "air"), (6, "south", 4.0, "road"), (6, "south", 4.0, "road")]
    return spark.createDataFrame(rows, "`Parcel No` long, Hub string, `Weight (kg)` double, Carrier string")


def fee_procedure():
    return Procedure("parcel_fees", [
        node("in", "source"), node("tidy", "clean_names", ["in"]),
        node("heavy", "filter", ["tidy"], rules=[{"col": "weight_kg", "op": ">", "param": "least"}]),
        node("single", "dedupe", ["heavy"], subset=["parcel_no"]),
        node("fee", "compute", ["single"], derived_column="fee", sql_expression="weight_kg * 1.5 + 2"),
        node("check", "assertion_gate", ["fee"], assertions=[{"type": "unique", "column": "parcel_no"},
                                                             {"type": "not_null", "column": "fee"}]),
        node("hub", "filter", ["check"], rules=[{"col": "hub", "op": "=", "param": "hub"}]), node("end", "output", ["hub"])],
        parameters=[{"name": "least", "type": "float", "default": 3.0, "min_value": 0},
                    {"name": "hub", "type": "enum", "default": "north", "allowed_values": ["north", "south"]}],
        golden_tests=[{"name": "north", "expected_row_count": 2, "expected_aggregates": {"fee": 67.0, "min(weight_kg)": 12.0},
                       "expected_columns": ["parcel_no", "hub", "weight_kg", "carrier", "fee"]},
                      {"name": "wrong", "params": {"hub": "south"}, "expected_row_count": 5}])


def test_pipeline_counts(parcels):
    result = run_procedure(fee_procedure(), {"default": parcels})
    assert [e["rows_out"] for e in result.lineage] == [8, 8, 6, 4, 4, 4, 2, 2]
    assert [e["rows_in"] for e in result.lineage] == [8, 8, 8, 6, 4, 4, 4, 2]
    assert {e["node_id"]: e["dropped_count"] for e in result.lineage if e["dropped_count"]} == {"heavy": 2, "single": 2, "hub": 2}
    assert {r["parcel_no"]: r["fee"] for r in result.df.collect()} == {3: 20.0, 5: 47.0}
    assert (result.rows_in, result.rows_out) == (8, 2)
    assert len({e["config_hash"] for e in result.lineage}) >= 6


def test_counts_survive_an_empty_branch(parcels):
    p = Procedure("p", [node("s", "source"), node("none", "filter", ["s"], rules=[{"col": "Hub", "val": "nowhere"}]),
                        node("j", "join", ["s", "none"], left_on="Parcel No", right_on="Parcel No")])
    result = run_procedure(p, {"default": parcels})
    assert [e["rows_out"] for e in result.lineage] == [8, 0, 0]


def counted(p, inputs, **options):
    """Rows out per node of a run and of the frames built apart."""
    from millrace.plans.procedure import _build

    order, frames = _build(p, inputs, None)
    found = {e["node_id"]: e["rows_out"] for e in run_procedure(p, inputs, **options).lineage}
    return found, {n["id"]: frames[n["id"]].count() for n in order}


@pytest.mark.parametrize("how", ["inner", "left", "full", "semi", "anti"])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_observed_counts_where_joins_stop_early(spark, how, broadcast):
    many = spark.range(5_000).selectExpr("id % 900 AS k", "id AS v")
    few = spark.range(40).selectExpr("id AS k", "id * 2 AS w")
    p = Procedure("p", [
        node("a", "source", dataset_name="many"), node("b", "source", dataset_name="few"),
        node("once", "dedupe", ["a"], subset=["k"]), node("some", "filter", ["once"], rules=[{"col": "v", "op": "<", "val": 4000}]),
        node("sums", "aggregate", ["b"], group_by=["k"], metrics=[{"agg": "sum", "col": "w", "alias": "w"}]),
        node("j", "join", ["some", "sums"], left_on="k", right_on="k", join_type=how), node("none", "filter", ["j"], rules=[
            {"col": "k", "op": ">", "val": 10_000}]),
        node("twice", "join", ["none", "a"], left_on="k", right_on="k"), node("out", "output", ["twice"])])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found, want = counted(p, {"many": many, "few": few})
        again, _ = counted(p, {"many": many.repartition(4, "k"), "few": few.limit(0)})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == want and again["a"] == 5_000 and again["once"] == 900 and again["b"] == 0
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) is None


def test_job_number_does_not_grow_with_the_nodes(spark, tmp_path):
    def jobs(steps, **options):
        nodes = [node("s", "source")]
        for i in range(steps):
            nodes += [node(f"f{i}", "filter", [nodes[-1]["id"]], rules=[{"col": "id", "op": ">", "val": i}]),
                      node(f"d{i}", "dedupe", [f"f{i}"], subset=["id"])]
        spark.sparkContext.setJobGroup(f"count-{steps}-{len(options)}", "")
        result = run_procedure(Procedure("p", nodes), {"default": spark.range(500)}, **options)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{steps}-{len(options)}"))
        spark.sparkContext.setJobGroup("", "")
        assert [e["rows_out"] for e in result.lineage][-1] == 500 - steps
        return found

    assert jobs(1) <= jobs(6) <= 8
    store = Snapshots(spark, str(tmp_path))
    assert jobs(6, dry_run=False, snapshots=store) <= 12 and store.read().count() == 494


def test_the_session_stays_serialisable(spark, parcels):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    run_procedure(fee_procedure(), {"default": parcels})
    scored = spark.createDataFrame([(0.0, 0.2), (1.0, 0.9)], "y double, p double")
    assert BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p").evaluate(scored) == 1.0


def test_a_branch_that_leads_nowhere_is_counted(parcels):
    p = Procedure("p", [node("s", "source"), node("side", "filter", ["s"], rules=[{"col": "Hub", "val": "north"}]),
                        node("main", "filter", ["s"], rules=[{"col": "Hub", "val": "south"}]), node("o", "output", ["main"])])
    found, want = counted(p, {"default": parcels})
    assert found == want and found["side"] == 4


def test_golden_cases_run(parcels):
    found = {r["name"]: r for r in run_golden_tests(fee_procedure(), {"default": parcels})}
    assert found["north"]["passed"] and not found["wrong"]["passed"]


@pytest.mark.parametrize("formula", [
    "log(weight_kg + 1) + (weight_kg ^ 2)", "concat(hub, '/', carrier)", "weight_kg / 0", "substr(hub, 0, 2)",
    "CASE WHEN weight_kg > 3 THEN 'it''s heavy' ELSE carrier END", "round(weight_kg / 3, 2) - -parcel_no % 4",
    "cast(weight_kg as varchar)", "hub = 'north' and not (carrier is null)", "replace(hub, 'o', '0')",
])
def test_sql_text_of_formulas(spark, parcels, formula):
    p = Procedure("p", [node("s", "source", dataset_name="parcels"), node("n", "clean_names", ["s"]),
                        node("c", "compute", ["n"], derived_column="x", sql_expression=formula),
                        node("again", "compute", ["c"], derived_column="hub", sql_expression="upper(hub)")])
    parcels.createOrReplaceTempView("parcels")
    want = build(p, {"parcels": parcels})
    got = spark.sql(procedure_sql(p, {"parcels": parcels}))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_gate_stops_and_warns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, 3.0)], "id double, val double")

    def gated(severity):
        return Procedure("g", [node("s", "source"), node("quality", "assertion_gate", ["s"], assertions=[
            {"type": "not_null", "column": "id", "severity": severity}])])

    with pytest.raises(ProcedureError, match="quality") as caught:
        build(gated("error"), {"default": df})
    assert caught.value.node == "quality" and caught.value.details[0].failing == 1
    assert build(gated("warn"), {"default": df}).count() == 3


def test_graph_checks():
    with pytest.raises(ValueError, match="wait for one another"):
        execution_order([node("a", "output", ["b"]), node("b", "output", ["a"])])
    with pytest.raises(ValueError, match="is no node"):
        execution_order([node("a", "output", ["b"])])
    with pytest.raises(ValueError, match="same id"):
        execution_order([node("a", "source"), node("a", "source")])
    assert [n["id"] for n in execution_order([node("b", "output", ["a"]), node("a", "source")])] == ["a", "b"]
    with pytest.raises(ProcedureError, match="no node is of type"):
        build(Procedure("p", [node("a", "teleport")]), {})


def test_trace_says_who_drops_what(parcels):
    p = fee_procedure()
    rows = [tuple(r) for r in trace.trace_drops(p, {"default": parcels}).select(
        "parcel_no", "copies", "mask", "dropped_by", "reason").collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 1, 1, "heavy", "does not match the filter"), (4, 1, 1, "heavy", "does not match the filter"),
        (3, 1, 2, "single", "repeats a key"), (6, 1, 2, "single", "repeats a key"), (2, 1, 4, "hub", "does not match the filter"),
        (6, 1, 4, "hub", "does not match the filter"), (3, 1, 0, None, None), (5, 1, 0, None, None)], key=str)
    counts = {r.dropped_by: r.n_rows for r in trace.drop_counts(trace.trace_drops(p, {"default": parcels})).collect()}
    assert counts == {e["node_id"]: e["dropped_count"] for e in run_procedure(p, {"default": parcels}).lineage if e["dropped_count"]}


def test_trace_with_gaps_fills_and_keys_of_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 3.0), (1, None), (1, 50.0), (2, None)], "k long, v double")
    p = Procedure("p", [
        node("s", "source"), node("low", "filter", ["s"], rules=[{"col": "v", "op": "!=", "val": 50.0}]),
        node("fill", "impute", ["low"], columns={"v": {"strategy": "zero"}}), node("one", "dedupe", ["fill"], subset=["k"]),
        node("j", "join", ["one", "s"], left_on="k", right_on="k")])
    found = trace.trace_drops(p, {"default": df})
    assert [n["id"] for n in trace.followed(p)] == ["s", "low", "fill", "one"]
    alone = Procedure("p", p.nodes[:4])
    got = sorted(((r.k, r.v, r.copies, r.dropped_by) for r in trace.trace_drops(alone, {"default": df}).collect()), key=str)
    assert found.count() == 6 and sum(r[2] for r in got) == 6
    order = build(alone, {"default": df})
    assert sorted(((r.k, r.v) for r in order.collect()), key=str) == [(k, v) for k, v, _, by in got if by is None]
    with pytest.raises(ProcedureError, match="source"):
        trace.trace_drops(alone, {"default": df}, source="zz")


def test_parameters():
    specs = [{"name": "f", "type": "float", "default": 100.0, "min_value": 0}, {"name": "b", "type": "bool", "default": True},
             {"name": "e", "type": "enum", "default": "A", "allowed_values": ["A", "B"]}]
    assert bind_parameters(specs) == {"f": 100.0, "b": True, "e": "A"}
    assert bind_parameters(specs, {"f": "250.5", "b": "no"})["f"] == 250.5
    for bad, word in (({"e": "Z"}, "none of the values"), ({"f": -1}, "less than")):
        with pytest.raises(ValueError, match=word):
            bind_parameters(specs, bad)
    with pytest.raises(ValueError, match="no value"):
        bind_parameters([{"name": "x", "required": True}])


def test_referential_and_score(spark):
    child = spark.createDataFrame([(1,), (2,), (9,), (None,)], "pid long")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    found = run_checks(child, [{"type": "referential", "column": "pid", "parent": "p", "parent_column": "id"},
                               {"type": "mystery", "column": "pid"}], {"p": parent})
    assert found[0].failing == 1 and not found[0].passed and not found[1].passed
    assert score_checks(child, [{"type": "uniqueness_check", "column": "pid"}])["score"] == 100.0


def test_sql_text_has_the_same_result(spark, parcels):
    parts = [
        node("src", "source", dataset_name="px"), node("n", "clean_names", ["src"]),
        node("fill", "impute", ["n"], columns={"weight_kg": {"strategy": "median"}, "carrier": {"strategy": "constant", "value": "it's"}}),
        node("d", "dedupe", ["fill"]), node("d2", "dedupe", ["d"], subset=["parcel_no"]),
        node("c", "cast", ["d2"], casts={"parcel_no": "varchar"}),
        node("f", "filter", ["c"], rules=[{"col": "hub", "op": "IN", "val": ["north", "south"]}, {"col": "carrier", "op": "IS NOT NULL"}]),
        node("g", "filter", ["c"], rules=[{"col": "weight_kg", "op": "<", "val": 5.0}]),
        node("u", "union", ["f", "g"]), node("x", "compute", ["u"], derived_column="twice", sql_expression="weight_kg * 2"),
        node("j", "join", ["x", "f"], join_type="left", left_on="parcel_no", right_on="parcel_no"),
        node("a", "aggregate", ["j"], group_by=["hub"], metrics=[{"agg": "sum", "col": "twice"}, {"agg": "count", "col": "*", "alias": "n"}]),
        node("o", "output", ["a"])]
    p = Procedure("p", parts)
    parcels.createOrReplaceTempView("px")
    want = sorted(map(tuple, build(p, {"px": parcels}).collect()))
    assert sorted(map(tuple, spark.sql(procedure_sql(p, {"px": parcels})).collect())) == want


def test_versions_and_idempotent_runs(spark, parcels, tmp_path):
    store = ProcedureStore(spark, str(tmp_path / "procs"))
    p = fee_procedure()
    store.publish(p)
    with pytest.raises(ValueError, match="already exists"):
        store.publish(p)
    snapshots = Snapshots(spark, str(tmp_path / "snaps"))
    first = store.run("parcel_fees", {"default": parcels}, key="k", snapshots=snapshots)
    again = store.run("parcel_fees", {"default": parcels}, key="k", snapshots=snapshots)
    assert first["created_at"] == again["created_at"] and len(snapshots.manifest()) == 1
    assert snapshots.manifest()[0]["action"] == "procedure_run:parcel_fees"
    with pytest.raises(ValueError, match="not found"):
        store.rollback("parcel_fees", "9.9.9")
    assert store.versions("parcel_fees") == ["1.0.0"] and store.load("parcel_fees").content_hash() == p.content_hash()


def test_an_idempotency_key_runs_once(spark, parcels, tmp_path):
    store = ProcedureStore(spark, str(tmp_path / "procs"))
    store.publish(fee_procedure())
    with pytest.raises(Exception):
        store.run("parcel_fees", {"default": parcels}, {"hub": "nowhere"}, key="k")
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(store.run, "parcel_fees", {"default": parcels}, {"hub": "south"}, None, False, "k") for _ in range(2)]
        ended = [r.exception() or r.result()["created_at"] for r in runs]
    assert sum(isinstance(e, StillRunning) for e in ended) == 1 or ended[0] == ended[1]
    assert store.run("parcel_fees", {"default": parcels}, {"hub": "south"}, key="k")["rows_out"] == 2
    assert store.run("parcel_fees", {"default": parcels}, key="k")["rows_out"] == 2


def test_stale_version_is_refused(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "sales double, region string")
    first = store.commit(df, "v0")
    with pytest.raises(ConflictError):
        store.commit(df, "v0")
    assert store.commit(df, f'"{first.version_id}"').version_id == "v2"
    assert store.commit(df, "*").snapshot_id == first.snapshot_id
    assert len(store.store.names("data")) == 1
    assert store.history().count() == 3 and store.read("v1").count() == 3
    with pytest.raises(ValueError):
        store.read("v99")


def test_exactly_one_of_two_writers_wins(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    frames = [spark.range(n).withColumnRenamed("id", "x") for n in (10, 20)]

    def write(df):
        try:
            return store.commit(df, "v0")
        except ConflictError:
            return None

    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(write, frames))
    assert sum(r is not None for r in results) == 1 and len(store.manifest()) == 1


def test_content_id_ignores_row_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i long, s string")
    c = spark.createDataFrame([(1, "x"), (2, "")], "i long, s string")
    assert content_id(a) == content_id(b) != content_id(c)
