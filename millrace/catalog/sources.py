"""Reading and writing: CSV, JSON, Parquet, pages, drop folders, snapshots and views.

Every query lands one of the given tables in the shared scratch folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators.profile import table_profile
from millrace.session import scratch_path
from millrace.sources import files, jdbc, nested
from millrace.sources.refresh import refresh_source
from millrace.sources.snapshots import Snapshots, content_id
from millrace.sources.workspace import Workspace


def _landed_json(t, df, name, path_part=""):
    path = scratch_path(t.spark, name)
    df.write.json(path + path_part)
    return path


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(t):
    path = scratch_path(t.spark, "customer-csv")
    files.write_csv(t.customer, path)
    out = files.read_csv(t.spark, path)
    return out.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal",
                      "c_mktsegment")


@query("src_csv_encoding", "SELECT doc_id, lang, source FROM documents")
def src_csv_encoding(t):
    path = scratch_path(t.spark, "latin-csv")
    rows = t.documents.select("doc_id", "lang", "source", F.lit("é").alias("mark"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    out = files.read_csv(t.spark, path, "doc_id bigint, lang string, source string, mark string")
    return out.where("mark = 'é'").drop("mark")


@query("sink_csv", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders")
def sink_csv(t):
    path = scratch_path(t.spark, "orders-csv")
    files.write_csv(t.orders, path)
    out = files.read_csv(t.spark, path, t.orders.schema, "UTF-8")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("src_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src_parquet(t):
    return files.read_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("sink_parquet", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def sink_parquet(t):
    path = scratch_path(t.spark, "orders-by-status")
    files.write_parquet(t.orders, path, ["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_json(t):
    path = scratch_path(t.spark, "wrapped-json")
    # a few suppliers per wrapper object, so no object holds the whole table
    wrapped = t.supplier.groupBy(F.expr("s_suppkey DIV 50").alias("part")).agg(
        F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("items"))
    wrapped.select(F.lit("ok").alias("status"), "items").write.json(path)
    return files.read_json(t.spark, path)


@query("json_flatten", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type AS "kind.name", user_id AS "kind.user.id" FROM events""")
def json_flatten(t):
    path = scratch_path(t.spark, "nested-json")
    t.events.select(
        "event_id", F.from_json("props", "k bigint").alias("props"),
        F.struct(F.col("event_type").alias("name"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("kind"),
    ).write.json(path)
    return files.read_json(t.spark, path)


@query("json_dig", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events""")
def json_dig(t):
    wrapped = t.events.select(
        "event_id", F.to_json(F.struct(F.struct(F.array(F.from_json("props", "k bigint")).alias("items")).alias("result")))
        .alias("body"))
    return wrapped.select("event_id", nested.dig(F.col("body"), "result.items.0.k").alias("k"))


@query("json_dig_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_dig_records(t):
    wrapped = t.events.select(
        "event_id", F.to_json(F.struct(F.struct(F.array(F.from_json("props", "k bigint")).alias("items")).alias("result")))
        .alias("body"))
    return nested.dig_records(wrapped, "body", "result.items", "struct<k:bigint>")


@query("src_latest", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def src_latest(t):
    folder = scratch_path(t.spark, "drop")
    files.write_csv(t.customer.select("c_custkey", "c_name").where("c_custkey % 2 = 0").coalesce(1), folder)
    first = files.list_files(t.spark, folder).count()
    files.write_csv(t.customer.select("c_custkey", "c_name").where("c_custkey % 2 = 1").coalesce(1), folder, "append")
    assert first == 1
    return files.read_latest(t.spark, folder, "c_custkey bigint, c_name string")


@query("src_paged", "SELECT p_partkey, p_name FROM part")
def src_paged(t):
    folder = scratch_path(t.spark, "pages")
    # the last page comes short; what a source landed after it by mistake does not count. A file holds many pages, as
    # thousands of folders of one small file each cost more than the rows in them
    rows = t.part.select("p_partkey", "p_name", F.expr("p_partkey DIV 150").alias("page"))
    stray = rows.agg((F.max("page") + 2).alias("page")).select(
        F.lit(-1).cast("long").alias("p_partkey"), F.lit("stray").alias("p_name"), "page")
    rows.unionByName(stray).write.json(folder)
    return files.read_pages(t.spark, folder, 150).select("p_partkey", "p_name")


@query("concat_chunks", "SELECT * FROM supplier")
def concat_chunks(t):
    folder = scratch_path(t.spark, "chunks")
    for start in (0, 1, 2):
        files.write_parquet(t.supplier.where(F.col("s_suppkey") % 3 == start), folder, mode="append")
    return t.spark.read.parquet(folder)


@query("view_register", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def view_register(t):
    ws = Workspace(t.spark)
    ws.register_all({"2024 Nations!": t.nation, "Region": t.region})
    return ws.sql("SELECT n_name, r_name FROM t_2024_nations_ JOIN region ON n_regionkey = r_regionkey")


@query("view_drop", "SELECT COUNT(*) AS n, FALSE AS still_there FROM nation")
def view_drop(t):
    ws = Workspace(t.spark)
    ws.register("gone_nation", t.nation)
    counted = ws.sql("SELECT COUNT(*) AS n FROM gone_nation").first()[0]
    ws.drop("gone_nation")
    return t.nation.agg(F.lit(counted).alias("n"), F.lit(t.spark.catalog.tableExists("gone_nation")).alias("still_there"))


@query("src_jdbc_meta")
def src_jdbc_meta(t):
    t.orders.createOrReplaceTempView("meta_orders")
    return jdbc.catalog_columns(t.spark, "meta_orders")


@query("sql_materialize", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1")
def sql_materialize(t):
    ws = Workspace(t.spark)
    ws.raw = t.orders
    ws.register("orders", t.orders)
    ws.materialize_sql("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", scratch_path(t.spark, "sql"))
    return ws.active()


@query("join_materialize", "SELECT 3 AS cols, COUNT(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey")
def join_materialize(t):
    ws = Workspace(t.spark)
    ws.register_all({"orders": t.orders, "customer": t.customer})
    out = ws.materialize_sql(
        "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
        scratch_path(t.spark, "join"))
    profile = table_profile(out, "joined")
    return out.agg(F.lit(profile["cols"]).alias("cols"), F.count(F.lit(1)).alias("n_rows"))


@query("refresh_source", "SELECT c_mktsegment, COUNT(*) AS n, (SELECT COUNT(*) FROM customer) AS n_rows FROM customer GROUP BY 1")
def refresh(t):
    ws = Workspace(t.spark)
    ws.raw = t.customer.limit(1)
    landed, profile = refresh_source(ws, lambda: t.customer, scratch_path(t.spark, "refresh"))
    assert ws.active() is landed
    return landed.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.lit(profile["rows"]).cast("bigint").alias("n_rows"))


@query("snapshot_commit", "SELECT * FROM orders WHERE o_totalprice > 1000")
def snapshot_commit(t):
    store = Snapshots(t.spark, scratch_path(t.spark, "snapshots"))
    first = store.commit(t.orders, "v0", "load")
    store.commit(t.orders.where("o_totalprice > 1000"), first.version_id, "clean")
    assert content_id(t.orders.repartition(7))[0] == first.snapshot_id
    return store.read()


@query("snapshot_list", """
    SELECT 'v1' AS version_id, 'v0' AS parent_version, 'load' AS action, COUNT(*) AS rows FROM customer
    UNION ALL SELECT 'v2', 'v1', 'dedupe', COUNT(*) FROM customer UNION ALL SELECT 'v3', 'v2', 'filter', COUNT(*) FROM customer WHERE c_acctbal > 0""")
def snapshot_list(t):
    store = Snapshots(t.spark, scratch_path(t.spark, "snapshots"))
    store.commit(t.customer, action="load")
    store.commit(t.customer.distinct(), "*", "dedupe")
    store.commit(t.customer.where("c_acctbal > 0"), action="filter")
    return store.history().select("version_id", "parent_version", "action", "rows")
