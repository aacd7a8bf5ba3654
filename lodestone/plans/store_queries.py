"""Store maintenance, logs and metrics, parsing of model replies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import doctor, observability, retrieval, store
from ..sources.shared import shared_folder
from ..streaming import metrics
from . import views as v
from .registry import query


@query("""
WITH o AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 10 = 0)
SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 <> 0 AND sha256(text) NOT IN (SELECT h FROM o) GROUP BY 1""")
def q42_sha_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    have = docs.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("sha256"))
    return store.additions(docs.where("doc_id % 10 <> 0"), have, "text", F.col("doc_id")).select("sha256", "doc_id")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("row_idx"), F.lit("local").alias("provider"), F.lit("hash").alias("embedding_model"), F.lit(256).alias("dim"))


@query("SELECT doc_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents WHERE doc_id % 3 <> 0")
def q43_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = v.chunks(spark, sf_dir).where("doc_id % 3 <> 0")
    return store.realigned(meta(spark, sf_dir), left).select("chunk_id", "row_idx")


@query("""
SELECT doc_id::VARCHAR AS chunk_id, doc_id AS row_idx FROM documents
UNION ALL SELECT 'b' || item_id, item_id + (SELECT max(doc_id) + 1 FROM documents) FROM benchmark""")
def q44_append_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = v.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chunk_id"), F.col("item_id").alias("row_idx"))
    return store.appended(meta(spark, sf_dir).select("chunk_id", "row_idx"), new)


@query("""
SELECT c_custkey AS doc_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS pages,
       (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS chunks FROM customer""")
def q45_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    return store.document_counts(v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), orders, orders.where("o_orderstatus = 'F'"))


@query("SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders) AS pages, (SELECT count(*) FROM lineitem) AS chunks, true AS has_embeddings")
def q46_store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "embeddings")
    return store.summary(v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "orders"), v.table(spark, sf_dir, "lineitem"), e, e)


@query("""
WITH r AS (SELECT source AS run_id, max(doc_id) % 7 AS mtime FROM documents GROUP BY source)
SELECT run_id, row_number() OVER (ORDER BY mtime DESC, run_id) <= 3 OR run_id = 'src5' AS retained FROM r""")
def q47_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg((F.max("doc_id") % 7).alias("mtime"))
    return store.retention(runs, 3, ["src5"]).select("run_id", "retained")


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type")
def q48_metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "events").select(F.lit("run").alias("run_id"), F.col("event_type").alias("stage"), F.lit("value").alias("metric_name"), "value")
    return observability.rolled_up(rows).select("stage", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("""
SELECT event_id, event_type AS stage, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'info' END AS level, len(json_keys(props)) AS fields,
       CASE WHEN event_id % 5 = 0 THEN round(value, 6) END AS value FROM events""")
def q49_log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of unlike fields, written by two appends and read back."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    events = v.table(spark, sf_dir, "events").withColumns({"timestamp": F.col("ts").cast("string"), "run_id": F.lit("run"), "stage": F.col("event_type"), "event": F.col("event_id").cast("string")})
    observability.logged(events.where("event_id % 5 <> 0").withColumn("level", F.lit("info")), path, "props")
    more = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.when(F.size(F.json_object_keys("props")) > 0, ", ").otherwise(""), F.lit('"__value": '), F.col("value").cast("string"), F.lit("}"))
    observability.logged(events.where("event_id % 5 = 0").withColumns({"level": F.lit("error"), "props": more}), path, "props")
    rows = observability.log_rows(spark, path)
    value = F.try_variant_get("record", "$.__value", "double")
    fields = F.size(F.json_object_keys(F.to_json("record"))) - len(observability.LOG) - F.when(value.isNotNull(), 1).otherwise(0)
    return rows.select(F.col("event").cast("long").alias("event_id"), "stage", "level", fields.cast("long").alias("fields"), F.round(value, 6).alias("value"))


@query("""
WITH h AS (SELECT o_custkey AS question_id, o_orderkey::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank,
                  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT question_id, chunk_id, (CASE WHEN rank = n THEN 1 ELSE rank + 1 END)::INT AS rank, 'partial_ids' AS status FROM h""")
def q50_rerank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked_orders(v.table(spark, sf_dir, "orders"))


def reranked_orders(orders: DataFrame) -> DataFrame:
    hits = orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").cast("string").alias("chunk_id"))
    hits = retrieval.renumbered(hits.withColumn("k", F.col("chunk_id").cast("long")), F.col("k")).drop("k")
    last = hits.groupBy("question_id").agg(F.max_by("chunk_id", "rank").alias("last"))
    raw = F.to_json(F.struct(F.array(F.col("last"), F.lit("unknown"), F.col("last")).alias("ranked_chunk_ids")))
    return retrieval.reranked(hits, last.select("question_id", raw.alias("raw"))).select("question_id", "chunk_id", "rank", "status")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5.0::DOUBLE ELSE least(10, p_size / 2)::DOUBLE END AS score,
       CASE WHEN p_partkey % 3 = 0 THEN 'no number here' ELSE 'because ' || p_name END AS reason FROM part""")
def q51_judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = v.table(spark, sf_dir, "part")
    reply = F.concat(F.lit("Score: "), (F.col("p_size") / 2).cast("string"), F.lit("\nReasoning: because "), F.col("p_name"))
    raw = F.when(F.col("p_partkey") % 3 == 0, "no number here").otherwise(reply)
    return part.select("p_partkey", t.judge_score(raw).alias("score"), t.judge_reason(raw).alias("reason"))


@query("""
SELECT 'nation' || n_nationkey AS name,
       CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 OR n = 0 THEN 'invalid' WHEN n_nationkey % 5 = 2 AND bad > 0 THEN 'invalid' ELSE 'valid' END AS status,
       CASE WHEN n_nationkey % 5 = 0 THEN 'Missing required file: nation=' || n_nationkey || '.' WHEN n_nationkey % 5 = 1 OR n = 0 THEN 'File is empty.'
            WHEN n_nationkey % 5 = 2 AND bad > 0 THEN 'Row ' || first || ' is missing non-empty `citations`.' ELSE 'Validated ' || n || ' answer row(s) with required fields.' END AS message
FROM nation JOIN (
  SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS bad, min(i) FILTER (c_custkey % 7 = 0) AS first
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) GROUP BY 1) ON c_nationkey = n_nationkey""")
def q52_doctor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of answers, one for each nation with its customers as answers: some are missing, some blank, and in some an
    answer lacks its citations. A blank line stands before each answer."""
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    key = F.col("c_nationkey")
    answer = F.to_json(F.struct(F.col("c_name").alias("answer_text"), F.when((key % 5 == 2) & (F.col("c_custkey") % 7 == 0), F.array().cast("array<string>")).otherwise(F.array("c_name")).alias("citations")))
    line = F.when(key % 5 == 1, " ").otherwise(F.concat(F.lit("\n"), answer))
    rows = v.table(spark, sf_dir, "customer").where(key % 5 != 0).select(key.alias("nation"), "c_custkey", line.alias("value"))
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(path)
    nations = [r[0] for r in v.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 files
    return doctor.checked(spark, [doctor.Wanted(f"nation{n}", f"{path}/nation={n}", "answers") for n in nations]).select("name", "status", "message")


@query("""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE 'local' END AS provider, 'm' || doc_id % 4 AS model, 256 + doc_id % 2 AS dim FROM documents)
SELECT 'unknown_chunk' AS "check", (SELECT count(*) FROM m WHERE doc_id % 50 = 0) AS bad
UNION ALL SELECT 'repeated_chunk', (SELECT count(*) FROM m WHERE doc_id % 20 = 1)
UNION ALL SELECT 'mixed_provider', count(DISTINCT provider) - 1 FROM m UNION ALL SELECT 'mixed_embedding_model', count(DISTINCT model) - 1 FROM m UNION ALL SELECT 'mixed_dim', count(DISTINCT dim) - 1 FROM m""")
def q53_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = v.chunks(spark, sf_dir).where("doc_id % 50 <> 0")
    rows = meta(spark, sf_dir).withColumns({"provider": F.when(F.col("row_idx") % 9 == 0, "other").otherwise(F.col("provider")), "embedding_model": F.concat(F.lit("m"), (F.col("row_idx") % 4).cast("string")), "dim": 256 + F.col("row_idx") % 2})
    return store.integrity(chunks.unionByName(chunks.where("doc_id % 20 = 1")), rows)


@query("SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def q54_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rolled_up(v.table(spark, sf_dir, "events"))
