"""Model training, metrics and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.cleaning import _GAPPY, gappy
from millrace.catalog.registry import query
from millrace.operators import learn
from millrace.operators.shape import split_train_test
from millrace.session import materialize, scratch_path
from millrace.sources.models import ModelRegistry


def _quality(t):
    """Labelled documents with a few features of their text, which are read many times and so computed once.

    The features are taken where a text is read, so the join moves numbers and never texts, whatever its plan. The
    patterns take runs: what they leave is the same as with single characters, in far fewer matches.
    """
    text = F.col("text")
    features = t.documents.select(
        "doc_id", "n_chars", "lang", "source", F.size(F.split(text, r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(text, "[.!?]")).cast("double").alias("n_sentences"),
        F.try_divide(F.length(F.regexp_replace(text, r"[^0-9]+", "")), F.length(text)).alias("digit_share"),
        F.try_divide(F.length(F.regexp_replace(text, r"[\w\s]+", "")), F.length(text)).alias("mark_share"))
    return materialize(t.labels.select("doc_id", "quality").join(features, "doc_id"))


@query("ml_detect_task", """
    SELECT 'l_returnflag' AS target, 'classification' AS task FROM (SELECT COUNT(*) FROM lineitem) UNION ALL
    SELECT 'l_linenumber', CASE WHEN COUNT(DISTINCT l_linenumber) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem UNION ALL
    SELECT 'l_extendedprice', CASE WHEN COUNT(DISTINCT l_extendedprice) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem""")
def ml_detect_task(t):
    rows = [(n, learn.detect_task(t.lineitem, n)) for n in ("l_returnflag", "l_linenumber", "l_extendedprice")]
    return t.spark.createDataFrame(rows, "target string, task string")


@query("ml_imbalance", """
    WITH c AS (SELECT toxic, COUNT(*) n FROM labels GROUP BY 1)
    SELECT ROUND(MIN(n) * 1.0 / SUM(n), 4)::DOUBLE AS minority_ratio, MIN(n) * 1.0 / SUM(n) < 0.15 AS is_imbalanced FROM c""")
def ml_imbalance(t):
    found = learn.detect_imbalance(t.labels, "toxic")
    return t.labels.agg(F.lit(found["minority_ratio"]).alias("minority_ratio"), F.lit(found["is_imbalanced"]).alias("is_imbalanced"))


@query("ml_feature_audit", f"""
    WITH g AS (SELECT qty, tax, price, flag, CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS code FROM {_GAPPY})
    SELECT 'qty' AS name, COUNT(*) FILTER (qty IS NULL) AS missing_count, COUNT(DISTINCT qty) AS n_unique, ROUND(corr(qty, price), 4) AS correlation, 'include' AS recommendation FROM g
    UNION ALL SELECT 'tax', COUNT(*) FILTER (tax IS NULL), COUNT(DISTINCT tax), ROUND(corr(tax, price), 4), 'drop_missing' FROM g
    UNION ALL SELECT 'flag', COUNT(*) FILTER (flag IS NULL), COUNT(DISTINCT flag), ROUND(corr(code, price), 4), 'include' FROM g
    UNION ALL SELECT 'double_price', COUNT(*) FILTER (price IS NULL), COUNT(DISTINCT ROUND(price * 2, 2)), 1.0, 'drop_leakage' FROM g""")
def ml_feature_audit(t):
    data = gappy(t).select("qty", "tax", "flag", "price", F.round(F.col("price") * 2, 2).alias("double_price"))
    return learn.audit_features(data, "price").select("name", "missing_count", "n_unique", "correlation", "recommendation")


@query("ml_leakage", "SELECT 'double_price' AS name, ROUND(corr(p_size * 2 + 1, p_size), 4) AS correlation, 'extreme' AS level FROM part")
def ml_leakage(t):
    data = t.part.select(F.col("p_size").cast("double").alias("p_size"), F.expr("p_size * 2 + 1.0D").alias("double_price"),
                         "p_retailprice")
    return learn.leakage_warnings(learn.audit_features(data, "p_size"))


@query("ml_encode", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, price, tax, CASE flag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::DOUBLE AS flag FROM {_GAPPY}""")
def ml_encode(t):
    return learn.encode_features(gappy(t))


@query("ml_impute", f"""
    WITH train AS (SELECT * FROM {_GAPPY} WHERE l_orderkey % 5 <> 0)
    SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(qty, (SELECT median(qty) FROM train)) AS qty, ROUND(COALESCE(price, (SELECT median(price) FROM train)), 4) AS price
    FROM {_GAPPY} WHERE l_orderkey % 5 = 0""")
def ml_impute(t):
    data = gappy(t).select("l_orderkey", "l_linenumber", "l_partkey", "qty", "price")
    values = learn.fit_fill(data.where("l_orderkey % 5 <> 0").select("qty", "price"))
    return learn.fill_from(data.where("l_orderkey % 5 = 0"), values).withColumn("price", F.round("price", 4))


@query("ml_downcast", "SELECT 'o_orderkey' AS name, 'int' AS type FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'o_custkey', CASE WHEN MAX(o_custkey) < 2147483648 THEN 'int' ELSE 'bigint' END FROM orders UNION ALL SELECT 'o_totalprice', 'float' FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'big', 'bigint' FROM (SELECT COUNT(*) FROM orders)")
def ml_downcast(t):
    out = learn.downcast(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.expr("o_orderkey + 5000000000").alias("big")))
    return t.spark.createDataFrame(out.dtypes, "name string, type string")


@query("ml_low_variance", "SELECT COUNT(*) AS n, 'p_partkey,p_size' AS kept FROM part")
def ml_low_variance(t):
    data = t.part.select("p_partkey", "p_size", F.lit(1).alias("same"), F.lit(None).cast("int").alias("empty"))
    out = learn.drop_low_variance(data)
    return out.agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(out.columns)).alias("kept"))


@query("ml_split", """
    SELECT event_type, COUNT(*) AS n, CAST(FLOOR(0.2 * (COUNT(*) - 1)) + 1 AS BIGINT) AS n_test FROM events GROUP BY 1""")
def ml_split(t):
    tagged = split_train_test(t.events, ["event_id"], "event_type")
    return tagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query("ml_metrics", """
    WITH p AS (SELECT l_extendedprice y, l_quantity * 2000 p FROM lineitem)
    SELECT 'mae' AS metric, ROUND(AVG(abs(y - p)), 4) AS value FROM p UNION ALL SELECT 'rmse', ROUND(sqrt(AVG((y - p) ** 2)), 4) FROM p
    UNION ALL SELECT 'mape', ROUND(AVG(abs(y - p) / y), 4) FROM p UNION ALL SELECT 'max_error', ROUND(MAX(abs(y - p)), 4) FROM p
    UNION ALL SELECT 'r2', ROUND(1 - AVG((y - p) ** 2) / var_pop(y), 4) FROM p UNION ALL SELECT 'explained_variance', ROUND(1 - var_pop(y - p) / var_pop(y), 4) FROM p""")
def ml_metrics(t):
    scored = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    return learn.metric_table(scored, learn.regression_metrics(scored, "y", "p"))


@query("ml_class_metrics", """
    WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, (l_quantity + l_discount) / 51 AS p FROM lineitem),
    k AS (SELECT y, rank() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s),
    a AS (SELECT (SUM(r) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / 2.0) / (COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y = 0)) AS auc FROM k)
    SELECT 'accuracy' AS metric, ROUND(AVG(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 4) AS value FROM s
    UNION ALL SELECT 'roc_auc', ROUND(auc::DOUBLE, 4) FROM a UNION ALL SELECT 'brier', ROUND(AVG((p - y) ** 2), 4) FROM s
    UNION ALL SELECT 'log_loss', ROUND(AVG(-(y * ln(LEAST(p, 1 - 1e-15)) + (1 - y) * ln(1 - LEAST(p, 1 - 1e-15)))), 4) FROM s""")
def ml_class_metrics(t):
    scored = t.lineitem.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
                               ((F.col("l_quantity") + F.col("l_discount")) / 51).alias("p"))
    guessed = scored.withColumn("g", (F.col("p") > 0.5).cast("int"))
    found = learn.binary_metrics(scored, "y", F.col("p")) | {"accuracy": learn.classification_metrics(guessed, "y", "g")["accuracy"]}
    return learn.metric_table(scored, found)


def _trained(t, data=None, **options):
    return learn.train_model(_quality(t) if data is None else data, "quality", ["doc_id"], exclude=["doc_id"], **options)


@query("ml_search")
def ml_search(t):
    found = _trained(t)
    return t.spark.createDataFrame(found.leaderboard, "family string, params string, score double")


@query("ml_importance")
def ml_importance(t):
    found = _trained(t, algorithms=["random forest"])
    return t.spark.createDataFrame(found.importance, "feature string, importance double")


@query("ml_attribution")
def ml_attribution(t):
    data = _quality(t)
    return learn.permutation_importance(_trained(t, data, algorithms=["rf"]), data, ["doc_id"])


@query("ml_register", """
    SELECT 'quality-1' AS model_id, 'archived' AS status, CASE WHEN COUNT(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM labels
    UNION ALL SELECT 'quality-2', 'production', CASE WHEN COUNT(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END FROM labels""")
def ml_register(t):
    registry = ModelRegistry(t.spark, scratch_path(t.spark, "models"))
    trained = _trained(t, algorithms=["linear"])
    registry.register("quality", trained)
    second = registry.register("quality", trained)["model_id"]
    registry.promote("quality-1", "production")
    registry.promote(second, "production")
    rows = [(r["model_id"], r["status"], r["task"]) for r in registry.models()]
    return t.spark.createDataFrame(rows, "model_id string, status string, task string")


@query("ml_batch_score")
def ml_batch_score(t):
    registry = ModelRegistry(t.spark, scratch_path(t.spark, "models"))
    data = _quality(t)
    model_id = registry.register("quality", _trained(t, data, algorithms=["linear"]))["model_id"]
    return registry.score(model_id, data).select("doc_id", "quality", "predicted_quality", "confidence")
