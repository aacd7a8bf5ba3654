"""Additions to stores, observed stages, scans of files, checked search, clients, and cleaning of text with any white space."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import additions, chunking, cleaning, evaluate, jobs, observability, retrieval
from ..sources import files, sinks, stores
from ..sources.shared import fixed, shared_folder
from . import views as v
from .job_queries import CLEANED_PAGES
from .registry import query


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Each document's text as a file; those with even ids come first, then all.
FILES = """f AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.pdf' AS path, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM documents),
u AS (SELECT *, sha256(text) AS sha FROM f QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY batch, path) = 1),
r AS (SELECT 'doc_' || substr(sha, 1, 12) AS doc_id, 1 AS page, text FROM u)"""
ADDED = f"""WITH {FILES}, {CLEANED_PAGES},
added AS (SELECT p.doc_id, batch, path, sha, CASE WHEN p.text = '(empty page)' THEN regexp_extract(path, '([^/]+)[.][^./]+$', 1) ELSE substr(string_split(p.text, chr(10))[1], 1, 200) END AS title,
             len(range(0, greatest(len({v.words("p.text")}), 1), 350)) AS n_chunks
      FROM p JOIN u ON p.doc_id = 'doc_' || substr(sha, 1, 12)),
numbered AS (SELECT *, sum(n_chunks) OVER (ORDER BY batch, doc_id ROWS UNBOUNDED PRECEDING) AS until FROM added)"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return v.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def added_twice(spark: SparkSession, sf_dir: str, metrics: observability.Metrics | None = None, log: observability.Log | None = None) -> stores.Store:
    store, found = stores.Store(spark, folder(spark, "store")), document_files(spark, sf_dir)
    for part in (found.where("doc_id % 2 = 0"), found):
        additions.add(store, part.drop("doc_id"), strategy="fixed", dimensions=8, metrics=metrics, log=log, size=400, overlap=50)
    return store


@query(f"{ADDED} SELECT doc_id, path AS source_path, sha AS sha256, title, 1::BIGINT AS n_pages, n_chunks::BIGINT AS n_chunks, (until - n_chunks)::BIGINT AS first_row, (until - 1)::BIGINT AS last_row, 8 AS dim FROM numbered")
def q65_incremental_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files, added to a store in two batches of which the second holds the first again."""
    store = added_twice(spark, sf_dir)
    rows = store.table("embeddings").join(store.table("chunks").select("chunk_id", "doc_id"), "chunk_id")
    numbers = rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.max("dim").alias("dim"))
    return store.table("documents").join(numbers, "doc_id").select("doc_id", "source_path", "sha256", "title", "n_pages", "n_chunks", "first_row", "last_row", "dim")


@query(f"""{ADDED},
counts AS (SELECT count(*) AS documents, sum(n_chunks) AS chunks, (SELECT count(*) + count(*) FILTER (batch = 0) FROM f) AS files FROM numbered)
SELECT 'ingest' AS stage, 'documents.count' AS metric_name, 2::BIGINT AS n, documents::DOUBLE AS total FROM counts
UNION ALL SELECT 'ingest', 'pages.count', 2, documents FROM counts UNION ALL SELECT 'ingest', 'duplicates.count', 2, files - documents FROM counts
UNION ALL SELECT 'chunking', 'chunks.count', 2, chunks FROM counts UNION ALL SELECT 'index_vector', 'chunks.indexed', 2, chunks FROM counts
UNION ALL SELECT s, s || '.seconds', 2, NULL FROM (VALUES ('ingest'), ('chunking'), ('index_vector')) AS x(s)
UNION ALL SELECT s, 'log ' || e, 2, NULL FROM (VALUES ('ingest'), ('chunking'), ('index_vector')) AS x(s), (VALUES ('start'), ('complete')) AS y(e)""")
def q66_ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What q65's two additions counted, timed and logged, read back."""
    metrics, log = observability.Metrics(spark, "run", folder(spark, "metrics")), observability.Log(spark, "run", folder(spark, "log"))
    added_twice(spark, sf_dir, metrics, log)
    rows = observability.rolled_up(observability.metric_rows(spark, metrics.path))
    total = F.when(~F.col("metric_name").endswith(".seconds"), F.col("total"))
    events = observability.log_rows(spark, log.path).groupBy("stage", F.concat(F.lit("log "), "event").alias("metric_name")).agg(F.count("*").alias("n"))
    return rows.select("stage", "metric_name", "n", total.alias("total")).unionByName(events.withColumn("total", F.lit(None).cast("double")))


@query("""
WITH g AS (SELECT l_returnflag AS stage, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS cheap, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT stage, 'rows.count' AS metric_name, n::DOUBLE AS value FROM g UNION ALL SELECT stage, 'cheap.count', cheap FROM g UNION ALL SELECT stage, 'quantity.count', quantity FROM g""")
def q66b_observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are taken while a job's rows pass, a stage for each flag of the line items."""
    metrics = observability.Metrics(spark, "run", folder(spark, "metrics"))
    lines = v.table(spark, sf_dir, "lineitem")
    for flag in [r[0] for r in lines.select("l_returnflag").distinct().collect()]:  # three
        with metrics.timer(flag) as stage:
            rows = stage.observe(lines.where(F.col("l_returnflag") == flag), rows=F.count("*"), cheap=F.count_if(F.col("l_discount") > 0.05), quantity=F.sum("l_quantity"))
            rows.write.format("noop").mode("overwrite").save()
    return observability.metric_rows(spark, metrics.path).where("metric_name LIKE '%.count'").select("stage", "metric_name", "value")


@query("""
WITH RECURSIVE d AS (SELECT s_suppkey % 3 AS k, s_suppkey AS idx, s_suppkey % 5 AS seed,
    CASE WHEN s_suppkey % 10 = 0 THEN ' nation  ' || s_nationkey % 4 || ' (' || s_suppkey % 6 || ') ' ELSE 'Nation ' || s_nationkey % 4 END AS question FROM supplier),
o AS (SELECT *, row_number() OVER (ORDER BY k, idx) AS n, trim(question) AS base FROM d),
r(n, seen, k, idx, question) AS (
  SELECT 0::BIGINT, []::VARCHAR[], 0::BIGINT, 0::BIGINT, ''
  UNION ALL
  SELECT o.n, list_append(r.seen, lower(regexp_replace(q, '\\s+', ' ', 'g'))), o.k, o.idx, q
  FROM r JOIN o ON o.n = r.n + 1, LATERAL (SELECT CASE WHEN NOT list_contains(r.seen, lower(regexp_replace(o.base, '\\s+', ' ', 'g'))) THEN o.base
    ELSE o.base || ' (' || list_filter(range(o.seed + 1, o.seed + 2 + len(r.seen)), lambda x: NOT list_contains(r.seen, lower(regexp_replace(o.base || ' (' || x || ')', '\\s+', ' ', 'g'))))[1] || ')' END AS q))
SELECT k::BIGINT AS k, idx, question FROM r WHERE n > 0""")
def q67_unique_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.table(spark, sf_dir, "supplier")
    nation = (F.col("s_nationkey") % 4).cast("string")
    planted = F.concat(F.lit(" nation  "), nation, F.lit(" ("), (F.col("s_suppkey") % 6).cast("string"), F.lit(") "))
    drafts = s.select((F.col("s_suppkey") % 3).alias("k"), F.col("s_suppkey").alias("idx"), (F.col("s_suppkey") % 5).alias("seed"), F.when(F.col("s_suppkey") % 10 == 0, planted).otherwise(F.concat(F.lit("Nation "), nation)).alias("question"))
    return evaluate.unique_questions(drafts, ["k", "idx"], seed="seed").select("k", "idx", "question")


@query("""
WITH l AS (SELECT event_id, value, event_id // 2000 AS part, row_number() OVER (PARTITION BY event_id // 2000 ORDER BY event_id) AS line_no FROM events)
SELECT part::INT AS part, line_no, event_id, value FROM l WHERE event_id % 10 > 2""")
def q68_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in several files; some lines are blank, and some hold JSON that is no object."""
    path = folder(spark, "lines")
    kind = F.col("event_id") % 10
    line = F.when(kind == 0, " ").when(kind == 1, "[1, 2]").when(kind == 2, '"text"').otherwise(F.to_json(F.struct("event_id", "value")))
    rows = v.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2000).cast("int").alias("part"), "event_id", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    read = files.json_lines(spark, f"{path}/*", "event_id long, value double")
    return read.select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("int").alias("part"), "line_no", "event_id", "value")


@query("""
WITH b AS (SELECT p_partkey::VARCHAR AS path, 2 AS page_num, 1 AS image_idx, p_brand AS name, p_size * 10.0::DOUBLE AS width, p_retailprice AS height FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 2, 2, 'img_2_2', 0, p_retailprice FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 3, 1, 'img_3_1', 150, p_size * 7.0::DOUBLE FROM part)
SELECT path, page_num, image_idx, name, round(width * height, 6) AS area,
       width >= 100 AND height >= 100 AND greatest(width, height) / greatest(1, least(width, height)) <= 8 AS diagram FROM b""")
def q69_image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a file for each part, as a parser of theirs gives them; which of them may be diagrams."""
    p = v.table(spark, sf_dir, "part")
    box = lambda **x: F.struct(*[c.alias(n) for n, c in x.items()])
    two = F.array(box(name=F.col("p_brand"), width=F.col("p_size") * 10.0, height=F.col("p_retailprice")))
    bare = F.array(box(width=F.lit("wide"), height=F.col("p_retailprice")))
    third = F.array(box(width=F.lit("150"), height=F.col("p_size") * 7.0))
    content = F.concat(F.lit('[[], ['), F.to_json(two[0]), F.lit(", "), F.to_json(bare[0]), F.lit("], "), F.to_json(third), F.lit("]"))
    boxes = files.image_boxes(p.select(F.col("p_partkey").cast("string").alias("path"), content.cast("binary").alias("content")), json.loads)
    some = files.diagrams(boxes).select("path", "page_num", "image_idx", F.lit(True).alias("diagram"))
    return boxes.join(some, ["path", "page_num", "image_idx"], "left").select("path", "page_num", "image_idx", "name", F.round("area", 6).alias("area"), F.coalesce("diagram", F.lit(False)).alias("diagram"))


@query(f"""
WITH {v.CHUNKS}, {v.QUESTIONS},
x AS (SELECT question_id::VARCHAR AS id, true AS asked, question AS text FROM questions UNION ALL SELECT chunk_id, false, chunk_text FROM chunks),
k AS (SELECT id, asked, unnest({v.tokens("text")}) AS t FROM x),
g AS (SELECT id, asked, ('0x' || substr(sha1(t), 1, 8))::BIGINT % 64 AS idx, CASE WHEN ('0x' || substr(sha1(t), 10, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM k),
w AS (SELECT id, asked, idx, sum(s)::BIGINT AS raw FROM g GROUP BY ALL),
n AS (SELECT id, asked, sum(raw * raw) AS nn FROM w GROUP BY ALL),
d AS (SELECT q.id AS question_id, c.id AS chunk_id, sum(q.raw * c.raw) AS dot FROM w q JOIN w c ON q.idx = c.idx WHERE q.asked AND NOT c.asked GROUP BY ALL),
p AS (SELECT question_id, c.chunk_id, doc_id, page, section, row_number() OVER (PARTITION BY question_id ORDER BY doc_id, page, section, c.chunk_id) AS place FROM questions, chunks c),
s AS (SELECT p.question_id, p.chunk_id, doc_id, page, section, place, round(coalesce(dot / (sqrt(a.nn) * sqrt(b.nn)), 0), 9) AS score
      FROM p LEFT JOIN d ON d.question_id = p.question_id::VARCHAR AND d.chunk_id = p.chunk_id
      LEFT JOIN n a ON a.asked AND a.id = p.question_id::VARCHAR LEFT JOIN n b ON NOT b.asked AND b.id = p.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) AS rank FROM s)
SELECT question_id, rank::INT AS rank, round(score, 6) AS score, chunk_id, doc_id, page, section FROM r WHERE rank <= 8""")
def q70_checked_vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an index that its plan holds against its chunks and the settings, with where each chunk comes from."""
    chunks = v.chunks(spark, sf_dir)
    index = fixed(jobs.index(chunks, dimensions=64))
    hits = jobs.vector_query(v.questions(spark, sf_dir), chunks, index, 8, "local", "hash", 64)
    return hits.select("question_id", "rank", F.round("score", 6).alias("score"), "chunk_id", "doc_id", "page", "section")


@query("""
WITH e AS (SELECT vec_id // 100 AS path, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS row_idx, embedding FROM embeddings)
SELECT path::VARCHAR AS path, row_idx, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM e""")
def q71_array_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as arrays in files of their own format, read back; a file holds the vectors of a hundred ids."""

    def saved(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.array(rows.sort_values("vec_id")["embedding"].tolist(), np.float32))
        return pd.DataFrame({"path": [str(rows["path"].iloc[0])], "content": [out.getvalue()]})

    vectors = v.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("string").alias("path"), "vec_id", "embedding")
    found = fixed(vectors.groupBy("path").applyInPandas(saved, "path string, content binary"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return files.npy_rows(found).select("path", "row_idx", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"))


def ranking_model(prompt: str) -> str:
    """Stands for a model: what it replies to a question is fixed by the question's number."""
    lines = prompt.split("\n")
    number, ids = int(next(x for x in lines if x.startswith("Question: ")).rsplit(" ", 1)[1]), json.loads(lines[-1])["ranked_chunk_ids"]
    if number % 5 == 4:
        raise TimeoutError(f"no reply to {number}")
    reply = {0: {"ranked_chunk_ids": ids[::-1]}, 1: {"ranked_chunk_ids": ["unknown", ids[-1], ids[-1]]}, 3: {"ranked_chunk_ids": [number]}}
    return json.dumps(reply[number % 5]) if number % 5 in reply else "The best one is " + ids[-1]


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
h AS (SELECT o_custkey, arg_max(o_orderkey, rank) AS last, arg_min(o_orderkey, rank) AS first, CASE WHEN count(*) > 1 THEN arg_min(o_orderkey, CASE WHEN rank = 1 THEN n + 1 ELSE rank END) END AS second,
             string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS kept, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank DESC) AS turned,
             string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE WHEN rank = n THEN 0 ELSE rank END) AS led FROM o GROUP BY 1)
SELECT c_custkey AS question_id,
       CASE WHEN h.o_custkey IS NULL THEN 'no_candidates' ELSE ['ok', 'partial_ids', 'invalid_json', 'invalid_schema', 'client_error'][c_custkey % 5 + 1] END AS status,
       CASE WHEN h.o_custkey IS NOT NULL AND c_custkey % 5 = 4 THEN 'no reply to ' || c_custkey END AS error,
       CASE c_custkey % 5 WHEN 0 THEN turned WHEN 1 THEN led ELSE kept END AS ranked
FROM customer LEFT JOIN h ON h.o_custkey = c_custkey""")
def q72_reranked_by_a_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders ranked anew by a client that at times names unknown ids, no JSON, another form, or fails;
    customers without orders have no candidates."""
    questions = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Orders of "), F.col("c_custkey").cast("string")).alias("question"))
    hits = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("key"))
    hits = retrieval.renumbered(hits, F.col("key")).drop("key")
    chunks = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("chunk_text"))
    ranked, statuses = retrieval.rerank(questions, hits, chunks, ranking_model)
    order = ranked.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("ranked"))
    return statuses.join(order, "question_id", "left").select("question_id", "status", "error", "ranked")


#: Lines of a page: running heads of each kind, numbers and single characters, and between them names, tabs and blanks around
#: them all; they end in three ways.
HEADS = ["PMBOK Guide", "pmbok® guide Seventh", "Project Management Institute.", "PMI.", "Copyright (c) 2021 someone", "page 7 of 742", "Page 8 / 9", "6th edition", "A Guide to the Project Management Body of Knowledge, part", "1234", "x"]
ENDS = ["\n", "\r\n", "\r"]


@query(f"""
SELECT c_nationkey AS doc_id, (c_custkey % 4)::INT AS page, coalesce(string_agg(c_name, chr(10) ORDER BY c_custkey) FILTER (c_custkey % {len(HEADS) + 3} >= {len(HEADS)}), '(empty page)') AS text FROM customer GROUP BY ALL""")
def q73_any_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers' names between heads of every kind, with tabs around lines that end in three ways."""
    n = (F.col("c_custkey") % (len(HEADS) + 3)).cast("int")
    line = F.coalesce(F.get(F.array(*map(F.lit, HEADS)), n), F.col("c_name"))
    whole = F.concat(F.element_at(F.array(F.lit("\t"), F.lit("  "), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int")), line, F.lit("\t"), F.element_at(F.array(*map(F.lit, ENDS)), (F.col("c_custkey") % 3 + 1).cast("int")))
    rows = v.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 4).cast("int").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", whole.alias("x")))), lambda x: x["x"]), "").alias("text"))
    return rows.select("doc_id", "page", t.page_text(F.col("text")).alias("text"))


@query("""
WITH p AS (SELECT s_nationkey AS doc_id, (s_suppkey % 5)::INT AS page, string_agg(s_name, chr(10) ORDER BY s_suppkey) AS names FROM supplier GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (page <> 0) AS with_foot FROM p GROUP BY 1)
SELECT doc_id, page, CASE WHEN pages >= 3 THEN '' ELSE 'Head of all' || chr(10) END || names || CASE WHEN page = 0 OR (pages >= 3 AND with_foot >= pages * 0.75::DOUBLE) THEN '' ELSE chr(10) || 'Foot' END AS text FROM p JOIN n USING (doc_id)""")
def q74_running_heads_of_any_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on most pages of a document go, however each of them ends."""
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("page") % 3 + 1).cast("int"))
    pages = v.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id"), (F.col("s_suppkey") % 5).cast("int").alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("names"))
    foot = F.when(F.col("page") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Foot")))
    text = F.array_join(F.transform(F.concat(F.array(F.lit("Head of all")), "names", foot), lambda x: F.concat(F.lit("\t"), x, F.lit(" \t"), end)), "")
    return cleaning.without_repeated_lines(pages.select("doc_id", "page", text.alias("text")), threshold=0.75)


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'Section' ELSE p_name END AS section,
       'Section ' || p_size || ',Section ' || p_partkey || '.2,Section ' || p_size || '.' || p_partkey % 3 || '.1,Section 77' AS refs FROM part""")
def q75_sections_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section names behind numbers in each form, and references of all five kinds, some twice and some that are none."""
    p = v.table(spark, sf_dir, "part")
    form = F.col("p_partkey") % 5
    number = F.col("p_partkey").cast("string")
    head = F.when(form == 0, F.concat(F.lit("Section "), number, F.lit(": "), "p_name")).when(form == 1, F.concat(F.lit("SECTION  "), number, F.lit(". "), "p_name"))
    head = head.when(form == 2, F.concat(F.lit("section "), number, F.lit("- "), "p_name")).when(form == 3, F.concat(F.lit(":- "), "p_name", F.lit(" -:"))).otherwise(F.concat(F.lit("Section "), number, F.lit(":")))
    size = F.col("p_size").cast("string")
    said = F.concat(F.lit("See exhibit 77, Table\t"), size, F.lit("."), (F.col("p_partkey") % 3).cast("string"), F.lit(".1 and figure "), number, F.lit(".2; Chapter  "), size, F.lit(", section "), size, F.lit(" again. TABLE 9, sections 4 and tables are none."))
    # they come by kind: sections, chapters, figures, tables, exhibits
    return p.select("p_partkey", t.section_of(F.concat(F.lit("\t\r\n "), head, F.lit("\t\r\nnext line"))).alias("section"), F.array_join(t.cross_references(said), ",").alias("refs"))


@query(f"""
WITH r AS (SELECT 'd' || doc_id AS doc_id, 1 AS page, coalesce(text, '') AS text FROM documents), {CLEANED_PAGES},
w AS (SELECT doc_id, section, {v.words("text")} AS w FROM p),
ch AS (SELECT doc_id, section, doc_id || '-p1-fixed-c' || (s // 462 + 1) AS chunk_id, CASE WHEN len(w) = 0 THEN '(empty)' ELSE array_to_string(w[s + 1:s + 512], ' ') END AS chunk_text
       FROM (SELECT *, unnest(range(0, greatest(len(w), 1), 462)) AS s FROM w)),
qs AS (SELECT item_id AS question_id, text AS question, list_distinct({v.tokens("text")}) AS a FROM benchmark),
cs AS (SELECT *, list_distinct({v.tokens("chunk_text")}) AS b FROM ch),
sc AS (SELECT question_id, question, doc_id, section, chunk_id, chunk_text, len(list_intersect(a, b)) AS inter, len(a) AS n1, len(b) AS n2 FROM qs, cs),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN n1 + n2 - inter = 0 THEN 0 ELSE inter::DOUBLE / (n1 + n2 - inter) END DESC, chunk_id) AS rank FROM sc)
SELECT question_id, 'For ''' || question || ''', the source states: ' || CASE WHEN length(chunk_text) > 280 THEN substr(chunk_text, 1, 277) || '...' ELSE chunk_text END AS answer_text,
       chunk_id, doc_id, 1 AS page, section FROM rk WHERE rank = 1""")
def q76_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw pages to an answer with one citation for each question."""
    raw = v.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("parsed"))
    return jobs.smoke(v.questions(spark, sf_dir), raw)


@query("""
WITH s AS (SELECT c_nationkey AS doc_id, c_custkey % 7 AS section_no, string_agg(c_name, ' ' ORDER BY c_custkey) AS content, list(c_name ORDER BY c_custkey) AS w FROM customer WHERE c_custkey % 7 <> 3 GROUP BY ALL),
k AS (SELECT doc_id, section_no, content, w, unnest(CASE WHEN len(w) <= 4 THEN [0] ELSE range(0, len(w) - 1, 3) END) AS s FROM s)
SELECT doc_id, 'chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY section_no, s) - 1)::VARCHAR, 6, '0') AS chunk_id, 'Part ' || section_no AS section_path, 2 AS section_level,
       CASE WHEN len(w) <= 4 THEN content ELSE array_to_string(w[s + 1:s + 4], ' ') END AS chunk_text FROM k""")
def q77_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each nation's sections, which hold its customers' names; one section is blank."""
    c = v.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 7).alias("section_no"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.regexp_replace("c_name", " ", "_").alias("c_name")))), lambda x: x["c_name"]), " ")
    sections = c.agg(names.alias("names")).withColumns({"content": F.when(F.col("section_no") == 3, " \n").otherwise(F.col("names")), "path": F.concat(F.lit("Part "), F.col("section_no").cast("string")), "level": F.lit(2)})
    return chunking.markdown_chunks(sections, 4, 1)


@query("""
SELECT 'run' || n_nationkey AS run_id, CASE WHEN n_nationkey % 7 = 0 THEN 'retained' ELSE 'deleted' END AS state FROM nation UNION ALL SELECT 'no such run', 'missing'""")
def q78_old_runs_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the nations' suppliers, written and then removed but for those to be kept."""
    root = folder(spark, "runs")
    nation = v.table(spark, sf_dir, "nation").select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("run"), "n_nationkey")
    rows = nation.join(v.table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("run", "s_name")
    rows.write.partitionBy("run").parquet(root)
    for part in files.run_names(spark, root, "."):  # Spark names a part's folder run=<run>
        fs, path = files.file_system(spark, f"{root}/{part}")
        fs.rename(path, files.file_system(spark, f"{root}/{part.removeprefix('run=')}")[1])
    keep = [f"run{n}" for n in range(0, 25, 7)] + ["no such run"]
    return sinks.runs_removed(spark, root, 0, keep, dry_run=False).select("run_id", "state")


@query("""
WITH v AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ' ' || p_size || chr(9) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.75' WHEN 3 THEN p_name WHEN 4 THEN '' WHEN 6 THEN 'none' WHEN 7 THEN p_size || 'e1' END AS raw, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN -p_size WHEN 2 THEN p_size + 0.75 WHEN 7 THEN p_size * 10 ELSE -1 END::DOUBLE AS number,
       CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN p_size WHEN 7 THEN p_size * 10 ELSE 5 END::INT AS "count", 
       CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM v""")
def q79_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, counts and flags of texts that at times are none."""
    p, size = v.table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    form = F.col("p_partkey") % 8
    raw = F.when(form == 0, F.concat(F.lit(" "), size, F.lit("\t"))).when(form == 1, F.concat(F.lit("-"), size)).when(form == 2, F.concat(size, F.lit(".75"))).when(form == 3, F.col("p_name")).when(form == 4, "").when(form == 6, "none").when(form == 7, F.concat(size, F.lit("e1")))
    word = F.get(F.array(*map(F.lit, [" YES\t", "off", "T", "n", "perhaps", ""])), (F.col("p_partkey") % 6).cast("int"))
    return p.select("p_partkey", t.number_or(raw, -1).alias("number"), t.count_or(raw, 5).alias("count"), t.flag(word).alias("flag"))
