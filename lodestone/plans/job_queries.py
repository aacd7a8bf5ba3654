"""Composed jobs, contents, tables and small predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking, cleaning, evaluate, jobs, store
from . import views as v
from .registry import query


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: each host is a document, each of its pages one of its pages, without tags."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return v.table(spark, sf_dir, "pages").select(host.alias("doc_id"), F.col("page_id").alias("page"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"), F.lit(False).alias("parsed"))


BOILERPLATE = "(?i)(" + "|".join(f"({p.replace('(?:®)?', '®?')})" for p in t.BOILERPLATE).replace("(?:", "(") + ")"
RAW_PAGES = r"""
r AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS doc_id, page_id AS page, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages)"""
#: What becomes of raw pages `r` (doc_id, page, text): the table `p`.
CLEANED_PAGES = rf"""
l AS (SELECT doc_id, page, i, trim(x) AS x FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM r)),
k AS (SELECT * FROM l WHERE length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '{BOILERPLATE}')
      UNION ALL SELECT doc_id, page, 0, '(empty page)' FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = r.doc_id AND l.page = r.page AND length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '{BOILERPLATE}'))),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM r GROUP BY doc_id),
o AS (SELECT doc_id, x FROM k JOIN n USING (doc_id) GROUP BY doc_id, x, pages HAVING pages >= 3 AND count(DISTINCT page) >= pages * 0.7::DOUBLE),
c AS (SELECT doc_id, page, string_agg(x, chr(10) ORDER BY i) AS text, arg_min(x, i) AS first FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = k.doc_id AND o.x = k.x) GROUP BY doc_id, page),
p AS (SELECT r.doc_id, r.page, coalesce(c.text, '(empty page)') AS text,
      CASE WHEN c.text IS NULL OR c.text = '(empty page)' THEN 'Section'
           ELSE coalesce(nullif(substr(trim(regexp_replace(c.first, '(?i)^section\s+\d+[.:\-]?\s*', ''), ' :-'), 1, 120), ''), 'Section') END AS section
      FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.page = r.page)"""
PAGES = f"{RAW_PAGES}, {CLEANED_PAGES}"


@query(f"WITH {PAGES} SELECT doc_id, page, section, text FROM p")
def q55_ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sectioned_pages(web_pages(spark, sf_dir)).drop("path")


@query(f"""
WITH {PAGES}, w AS (SELECT doc_id, page, section, {v.words("text")} AS w FROM p),
s AS (SELECT *, unnest(range(0, greatest(len(w), 1), 350)) AS s FROM w),
h AS (SELECT doc_id, page, section, doc_id || '-p' || page || '-fixed-c' || (s // 350 + 1) AS chunk_id, CASE WHEN len(w) = 0 THEN '(empty)' ELSE array_to_string(w[s + 1:s + 400], ' ') END AS chunk_text FROM s)
SELECT doc_id, page, section, chunk_id, chunk_text, CASE WHEN contains(chunk_text, 'TABLE:') THEN 'table' ELSE 'text' END AS chunk_type FROM h""")
def q56_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_pages(jobs.sectioned_pages(web_pages(spark, sf_dir)), "fixed", size=400, overlap=50)
    return chunking.enriched(chunks).select("doc_id", "page", "section", "chunk_id", "chunk_text", "chunk_type")


@query(f"""
WITH {v.CHUNKS}, t AS (SELECT chunk_id AS id, unnest({v.tokens("chunk_text")}) AS t FROM chunks),
g AS (SELECT id, (('0x' || substr(sha1(t), 1, 8))::BIGINT % 256)::INT AS idx, CASE WHEN ('0x' || substr(sha1(t), 10, 1))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM t),
w AS (SELECT id, idx, sum(s) AS raw FROM g GROUP BY id, idx HAVING sum(s) <> 0),
e AS (SELECT id, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM w),
x AS (SELECT id, sum(weight) AS total, count(*) AS filled FROM e GROUP BY id)
SELECT row_number() OVER (ORDER BY doc_id, page, section, chunk_id) - 1 AS row_idx, chunk_id, 256 AS dim, coalesce(filled, 0) AS filled, abs(round(coalesce(total, 0), 4)) AS total FROM chunks LEFT JOIN x ON id = chunk_id""")
def q57_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.index(v.chunks(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("row_idx", "chunk_id", "dim", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), F.abs(F.round(total, 4)).alias("total"))


@query("""
WITH e AS (
  SELECT s_nationkey AS doc_id, s_suppkey AS pos, (s_suppkey % 9 + 1) || CASE WHEN s_suppkey % 3 = 0 THEN '.2' ELSE '' END AS number, s_name AS title,
         CASE WHEN s_suppkey % 4 = 3 THEN 14 ELSE (s_suppkey % 40)::INT END AS page FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT doc_id, number, page, arg_max(title, pos) AS title, (1 + length(number) - length(replace(number, '.', '')))::INT AS level FROM e GROUP BY doc_id, number, page""")
def q58_contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of invented guides, one for each nation: its suppliers as entries, in each of the forms, and lines that are
    none; on a page before them there is no heading."""
    s = v.table(spark, sf_dir, "supplier")
    number = F.concat((F.col("s_suppkey") % 9 + 1).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".2").otherwise(""))
    page = (F.col("s_suppkey") % 40).cast("string")
    form = F.col("s_suppkey") % 4
    line = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("no entry "), "s_name"))
    line = line.when(form == 0, F.concat(number, F.lit(" "), "s_name", F.lit(" ...... "), page)).when(form == 1, F.concat(number, F.lit(" "), "s_name", F.lit(" "), page))
    line = line.when(form == 2, F.concat(number, F.lit(" "), "s_name", F.lit("     "), page)).otherwise(F.concat(number, F.lit(". "), "s_name", F.lit("  xiv")))
    listed = s.groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    pages = listed.select("doc_id", F.lit(2).alias("page"), F.concat(F.lit("A guide\n contents \n"), "text").alias("text"))
    pages = pages.unionByName(listed.select("doc_id", F.lit(1).alias("page"), F.lit("1 Preface 3").alias("text")))
    return cleaning.contents_entries(cleaning.contents_lines(pages)).select("doc_id", "number", "page", "title", "level")


@query("""
WITH c AS (SELECT c_nationkey AS doc_id, (c_custkey % 5)::INT AS page, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 5) AS n FROM customer)
SELECT DISTINCT doc_id, page, 'p' || page || '-t1' AS table_id, 3 AS width, '| a | b |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  | c | d |' AS markdown FROM c
UNION ALL SELECT doc_id, page, 'p' || page || '-t2', 2, string_agg('| ' || c_custkey || ' | ' || c_name || '\\| |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i)
FROM (SELECT *, 1 AS one FROM c WHERE n >= 2) GROUP BY doc_id, page""".replace("\\\\|", "\\|"))
def q59_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of invented pages: two lines with bars, and customers in columns set apart by blanks, apart from each other."""
    c = v.table(spark, sf_dir, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit("   "), "c_name", F.lit("|"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit("a | b |\n| c | d\nbetween\n"), F.array_join(rows, "\nplain\n"))
    pages = c.groupBy(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 5).cast("int").alias("page")).agg(text.alias("text"))
    return cleaning.page_tables(pages)


@query("""
SELECT p_partkey, p_size >= 10 AND p_retailprice >= 100 AND greatest(p_size * 10, p_retailprice) / greatest(1, least(p_size * 10, p_retailprice)) <= 8 AS diagram,
       regexp_matches(p_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS run_name, regexp_matches(lower(p_type), 'embed|bge|e5|gte|mxbai|all-minilm') AS embedder,
       p_brand || ',' || (CASE WHEN contains(p_brand, ':') THEN split_part(p_brand, ':', 1) ELSE p_brand || ':latest' END) AS variants FROM part""")
def q60_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        t.is_diagram(F.col("p_size") * 10.0, F.col("p_retailprice")).alias("diagram"),
        t.is_run_id(F.col("p_name")).alias("run_name"),
        t.is_embedding_model(F.col("p_type")).alias("embedder"),
        F.array_join(t.model_variants(F.col("p_brand")), ",").alias("variants"),
    )


@query("SELECT l_orderkey AS question_id, round(avg(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END), 6) AS avg_score FROM lineitem GROUP BY l_orderkey")
def q61_judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("double"))
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("criterion"), score.alias("score"))
    return evaluate.judge_means(rows).withColumn("avg_score", F.round("avg_score", 6))


@query("""
WITH r AS (SELECT source AS run_id, max(doc_id) % 7 AS mtime FROM documents GROUP BY source)
SELECT run_id, CASE WHEN row_number() OVER (ORDER BY mtime DESC, run_id) <= 3 OR run_id = 'src5' THEN 'retained' ELSE 'removable' END AS state FROM r
UNION ALL SELECT 'no such run', 'missing' UNION ALL SELECT 'src5', 'missing' WHERE NOT EXISTS (SELECT 1 FROM r WHERE run_id = 'src5')""")
def q62_kept_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg((F.max("doc_id") % 7).alias("mtime"))
    return store.kept_sets(runs, spark.createDataFrame([("src5",), ("no such run",)], "run_id string"))


@query()
def q63_app_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid answers to the benchmark's questions, over the graph of the documents' own relations."""
    chunks = v.chunks(spark, sf_dir)
    return jobs.answered(v.questions(spark, sf_dir), chunks, "hybrid", built=jobs.graph_of(chunks)).withColumn("citations", F.array_join("citations", ","))


@query(f"""
WITH {v.CHUNKS}, {v.QUESTIONS},
q AS (SELECT question_id, list_distinct({v.tokens("question")}) AS a FROM questions),
c AS (SELECT chunk_id, chunk_text, list_distinct({v.tokens("chunk_text")}) AS b FROM chunks),
s AS (SELECT question_id, chunk_id, chunk_text, len(list_intersect(a, b)) AS inter, len(a) AS n, len(b) AS m FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN n + m - inter = 0 THEN 0 ELSE inter::DOUBLE / (n + m - inter) END DESC, chunk_id) AS rank FROM s)
SELECT question_id, chunk_id, CASE WHEN length(chunk_text) > 280 THEN substr(chunk_text, 1, 277) || '...' ELSE chunk_text END AS excerpt FROM r WHERE rank = 1""")
def q64_smoke_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.smoke_answers(v.questions(spark, sf_dir), v.chunks(spark, sf_dir))
