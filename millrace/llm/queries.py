"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from millrace.llm import (
    decontaminate,
    html_extract,
    languages,
    lexical,
    packing,
    pii,
    shards,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
    toxicity,
    whitening,
)
from millrace.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@register
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@register
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_spans(read_table(spark, folder, "documents"))


@register
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "embeddings")
    vectors = table.select("vec_id", topk.integers(F.col("embedding")).alias("values"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLES["op3_topk"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS values
        FROM embeddings
    ), s AS (
        SELECT q.vec_id AS query_id, x.vec_id,
               CAST(list_sum(list_transform(list_zip(q.values, x.values), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    ) WHERE rank <= 10
"""


@register
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, folder, "documents"))


@register
def op5_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.minimax_shards(read_table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = languages.fit(docs.where(~languages.held_out()))
    return languages.identify(docs, model).select(
        "doc_id", F.coalesce(languages.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@register
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    return decontaminate.contained_items(docs, items)


def _duckdb_words(table: str, key: str) -> str:
    marks = decontaminate.MARKS
    codes = "||".join(f"chr({ord(m)})" for m in marks)
    plain = f"translate(lower(coalesce(text, '')), {codes}, repeat(' ', {len(marks)}))"
    return f"SELECT {key}, list_filter(string_split({plain}, ' '), lambda w: w <> '') AS w FROM {table}"


def _duckdb_shingles(words: str, key: str) -> str:
    places = "generate_series(1, greatest(len(w) - 4, 1))"
    return (f"SELECT DISTINCT {key}, unnest(list_transform({places}, lambda i: array_to_string(w[i:i + 4], ' '))) AS g "
            f"FROM ({words}) WHERE len(w) > 0")


ORACLES["op7_decontaminate"] = f"""
    WITH d AS ({_duckdb_shingles(_duckdb_words("documents", "doc_id"), "doc_id")}),
         b AS ({_duckdb_shingles(_duckdb_words("benchmark", "item_id"), "item_id")}),
         n AS (SELECT item_id, count(*) AS shingles FROM b GROUP BY item_id),
         m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment
    FROM m JOIN n USING (item_id) WHERE shared / shingles >= 0.8
"""


@register
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.training()))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(~toxicity.training(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = packing.with_clusters(read_table(spark, folder, "documents"))
    return packing.pack(docs, size=F.col("size"), cluster=F.col("near_copies"))


@register
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def _duckdb_terms(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    other = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    return f"SELECT {key}, unnest(regexp_extract_all({plain}, {other})) AS term FROM {table}"


ORACLES["op11_lexical_search"] = f"""
    WITH dt AS ({_duckdb_terms("documents", "doc_id")}),
         it AS ({_duckdb_terms("benchmark", "item_id")}),
         q AS (SELECT item_id, term, count(*) AS asked FROM it GROUP BY item_id, term),
         n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
         s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
         t AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
               FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
         p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS part
               FROM t JOIN n USING (doc_id) JOIN w USING (term), s),
         r AS (SELECT item_id, doc_id, CAST(sum(asked * part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
    ) WHERE rank <= 20
"""


@register
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@register
def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


@register
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
