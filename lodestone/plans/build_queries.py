"""Cleaning and structure of pages and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking, cleaning
from . import views as v
from .registry import query


@query("""
WITH p AS (SELECT source, doc_id AS page, text FROM documents),
l AS (SELECT source, page, i, trim(x) AS line FROM (SELECT source, page, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM p) WHERE trim(x) <> ''),
n AS (SELECT source, count(DISTINCT page) AS pages FROM p GROUP BY source),
o AS (SELECT source, line FROM l JOIN n USING (source) GROUP BY source, line, pages HAVING pages >= 3 AND count(DISTINCT page) >= pages * 0.15::DOUBLE),
k AS (SELECT source, page, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = l.source AND o.line = l.line) GROUP BY source, page)
SELECT p.source, p.page, coalesce(k.text, '(empty page)') AS text FROM p LEFT JOIN k ON k.source = p.source AND k.page = p.page""")
def q31_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = v.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return cleaning.without_repeated_lines(pages, "source", "page", 0.15)


@query("""
WITH l AS (SELECT doc_id, i, trim(x) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM l WHERE length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '(empty page)') AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def q32_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", t.page_text(F.col("text")).alias("text"))


@query("""
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS x FROM documents)
SELECT doc_id, substr(x, 1, 200) AS title, coalesce(nullif(substr(trim(x, ' :-'), 1, 120), ''), 'Section') AS section FROM f""")
def q33_title_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", F.substring(t.first_line(F.col("text")), 1, 200).alias("title"), t.section_of(F.col("text")).alias("section"))


@query("""
SELECT p_partkey, 'Section ' || (p_partkey % 7) || '.1,Section ' || (p_size % 5) AS refs FROM part WHERE p_partkey % 7 <> 0 OR true""")
def q34_crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = v.table(spark, sf_dir, "part")
    text = F.concat(F.lit("See Table "), (F.col("p_size") % 5).cast("string"), F.lit(" and section "), (F.col("p_partkey") % 7).cast("string"), F.lit(".1, again Section "), (F.col("p_partkey") % 7).cast("string"), F.lit(".1."))
    return part.select("p_partkey", F.array_join(t.cross_references(text), ",").alias("refs"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries of invented guides, one for each region: nations as chapters and their numbers as sections."""
    n = v.table(spark, sf_dir, "nation")
    chapter = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 10).alias("pos"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 4 + 1).alias("page"), F.lit(1).alias("level"))
    part = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 10 + 1).alias("pos"), F.concat(F.lit("About "), F.col("n_name")).alias("title"), (F.col("n_nationkey") * 4 + 2).alias("page"), F.lit(2).alias("level"))
    return cleaning.contents_paths(chapter.unionByName(part))


ENTRIES = """e AS (
  SELECT n_regionkey AS doc_id, n_nationkey * 10 AS pos, n_name AS title, n_nationkey * 4 + 1 AS page, n_name AS path FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey * 10 + 1, 'About ' || n_name, n_nationkey * 4 + 2, n_name || ' / About ' || n_name FROM nation)"""


@query(f"WITH {ENTRIES} SELECT doc_id, page::INT AS page, path FROM e")
def q35_toc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("doc_id", F.col("page").cast("int").alias("page"), "path")


@query(f"""
WITH {ENTRIES}, x AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page, pos) - 1, 120) AS last FROM e)
SELECT doc_id, p::INT AS page, path FROM (SELECT doc_id, path, unnest(range(page, last + 1)) AS p FROM x)""")
def q36_toc_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.page_sections(entries(spark, sf_dir), F.lit(120)).select("doc_id", F.col("page").cast("int").alias("page"), "path")


@query(f"""
WITH {ENTRIES}, q AS (SELECT DISTINCT c_nationkey % 5 AS doc_id, (c_custkey % 110)::INT AS page FROM customer),
f AS (SELECT doc_id, arg_min(path, page) AS first FROM e GROUP BY doc_id)
SELECT q.doc_id, q.page, coalesce(e.path, f.first) AS path FROM q ASOF LEFT JOIN e ON q.doc_id = e.doc_id AND q.page >= e.page LEFT JOIN f ON f.doc_id = q.doc_id""")
def q37_toc_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.table(spark, sf_dir, "customer")
    pages = c.select((F.col("c_nationkey") % 5).alias("doc_id"), (F.col("c_custkey") % 110).cast("int").alias("page")).distinct()
    return cleaning.section_as_of(pages, entries(spark, sf_dir).withColumn("page", F.col("page").cast("int")))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of nations for each region, with a line before it."""
    n = v.table(spark, sf_dir, "nation")
    head = v.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("pos"), F.lit(x).alias("line")) for k, x in enumerate(["Nations", "| Key | Name |"])])))
    order = F.row_number().over(cleaning.Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = n.select(F.col("n_regionkey").alias("doc_id"), (order + 1).cast("long").alias("pos"), F.concat(F.lit("|"), F.col("n_nationkey").cast("string"), F.lit(" |  "), F.col("n_name")).alias("line"))
    return head.unionByName(rows)


@query("""
SELECT n_regionkey AS doc_id, 1 AS table_no, 4 AS width,
       '|  | Key | Name |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('|  | ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown
FROM nation GROUP BY n_regionkey""")
def q38_pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.pipe_tables(table_lines(spark, sf_dir), ["doc_id"])


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text for each region: a heading, and one below it for each nation, with two lines of text."""
    n = v.table(spark, sf_dir, "nation")
    head = v.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("# "), F.col("r_name")).alias("line"))
    parts = F.array(F.concat(F.lit("## "), F.col("n_name")), F.concat(F.lit("Number "), F.col("n_nationkey").cast("string")), F.lit("of all."), F.lit(""))
    rows = n.select(F.col("n_regionkey").alias("doc_id"), "n_nationkey", F.posexplode(parts).alias("k", "line")).select("doc_id", (F.col("n_nationkey") * 4 + F.col("k")).cast("long").alias("pos"), "line")
    return head.unionByName(rows)


@query("""
SELECT r_regionkey AS doc_id, 1::BIGINT AS section_no, r_name AS path, '' AS content FROM region
UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1, r_name || ' / ' || n_name, 'Number ' || n_nationkey || chr(10) || 'of all.'
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q39_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.markdown_sections(markdown_lines(spark, sf_dir)).select("doc_id", "section_no", "path", "content")


@query(f"""
WITH w AS (SELECT doc_id, text, {v.words("text")} AS w FROM documents),
s AS (SELECT doc_id, text, w, CASE WHEN len(w) <= 400 THEN 0 ELSE unnest(range(0, greatest(0, len(w) - 50 - 1) + 1, 350)) END AS s FROM w)
SELECT DISTINCT doc_id, (s // 350 + 1)::INT AS chunk_no, CASE WHEN len(w) <= 400 THEN text ELSE array_to_string(w[s + 1:s + 400], ' ') END AS chunk_text FROM s""")
def q40_md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.markdown_windows(F.col("text"), 400, 50)).alias("chunk_no", "chunk_text")).withColumn("chunk_no", F.col("chunk_no") + 1)


@query("""
SELECT n_regionkey AS doc_id, 'Number ' || n_nationkey || ' of all.' AS text FROM nation
UNION ALL SELECT n_regionkey, '## ' || n_name FROM nation UNION ALL SELECT r_regionkey, '# ' || r_name FROM region""")
def q41_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.paragraphs(markdown_lines(spark, sf_dir)).select("doc_id", "text")
