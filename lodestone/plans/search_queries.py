"""Lexical and vector search, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, retrieval, vectors
from . import views as v
from .registry import query

LEXICAL = f"""
WITH {v.CHUNKS}, {v.QUESTIONS},
q AS (SELECT question_id, list_distinct({v.tokens("question")}) AS a FROM questions),
c AS (SELECT chunk_id, list_distinct({v.tokens("chunk_text")}) AS b FROM chunks),
s AS (SELECT question_id, chunk_id, len(list_intersect(a, b)) AS inter, len(a) AS n, len(b) AS m FROM q, c),
j AS (SELECT question_id, chunk_id, CASE WHEN n + m - inter = 0 THEN 0 ELSE inter::DOUBLE / (n + m - inter) END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM j)
"""


@query(LEXICAL + "SELECT question_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 8")
def q01_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_search(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), 8).withColumn("score", F.round("score", 6))


@query(LEXICAL + "SELECT question_id, rank::INT AS rank, chunk_id FROM r WHERE rank <= 1")
def q02_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.lexical_search(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), 8)
    return retrieval.truncated(hits, 0).select("question_id", "rank", "chunk_id")


@query(f"""
WITH w AS (SELECT doc_id, {v.words("text")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 350)) AS s FROM w)
SELECT doc_id, (s // 350 + 1)::INT AS chunk_no, doc_id || '-p1-fixed-c' || (s // 350 + 1) AS chunk_id,
       CASE WHEN len(w) = 0 THEN '(empty)' ELSE array_to_string(w[s + 1:s + 400], ' ') END AS chunk_text
FROM s""")
def q03_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_pages(v.pages(spark, sf_dir).drop("source"), "fixed", size=400, overlap=50)
    return chunks.select("doc_id", "chunk_no", "chunk_id", "chunk_text")


@query(f"""
WITH s AS (SELECT doc_id, {v.sentence_list("text")} AS s FROM documents),
k AS (SELECT doc_id, s, unnest(range(0, len(s), 3)) AS k FROM s)
SELECT doc_id, (k // 3 + 1)::INT AS chunk_no,
       CASE WHEN s[1] = '' THEN '(empty)' ELSE array_to_string(s[k + 1:k + 3], ' ') END AS chunk_text FROM k""")
def q04_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(v.pages(spark, sf_dir), "sentence_window", window=3).select("doc_id", "chunk_no", "chunk_text")


@query("""
WITH l AS (
  SELECT doc_id, i, trim(x) AS x FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE trim(x) <> ''),
h AS (
  SELECT *, length(x) <= 90 AND (starts_with(x, '#') OR (
      NOT regexp_matches(x, '(^|[^\\p{Lu}\\p{Ll}\\p{Lt}])\\p{Ll}') AND NOT regexp_matches(x, '[\\p{Lu}\\p{Ll}\\p{Lt}]\\p{Lu}')
      AND len(regexp_split_to_array(x, '\\s+')) <= 8)) AS heading
  FROM l),
b AS (
  SELECT *, sum(CASE WHEN heading OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 AS first FROM h))
SELECT doc_id, block::INT AS block, string_agg(x, ' ' ORDER BY i) AS text FROM b GROUP BY doc_id, block""")
def q05_heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = v.pages(spark, sf_dir).select("doc_id", F.posexplode(chunking.heading_blocks(F.col("text"))).alias("block", "text"))
    return blocks.select("doc_id", (F.col("block") + 1).alias("block"), "text")


@query(f"""
WITH RECURSIVE s AS (
  SELECT doc_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, {v.sentence_list("text")} AS x FROM documents)),
t AS (SELECT doc_id, i, s, list_distinct({v.tokens("s")}) AS t, len({v.words("s")}) AS n FROM s),
j AS (
  SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1 AS last FROM t),
a AS (
  SELECT doc_id, i, n, last, CASE WHEN p IS NULL THEN 1 WHEN len(t) + len(p) - len(list_intersect(t, p)) = 0 THEN 0
         ELSE len(list_intersect(t, p))::DOUBLE / (len(t) + len(p) - len(list_intersect(t, p))) END AS alike FROM j),
f(doc_id, i, words, chunk, closed) AS (
  SELECT doc_id, i, n, 1, n >= 60 FROM a WHERE i = 1
  UNION ALL
  SELECT a.doc_id, a.i, CASE WHEN f.closed THEN a.n ELSE f.words + a.n END, CASE WHEN f.closed THEN f.chunk + 1 ELSE f.chunk END,
         (NOT f.closed AND a.alike < 0.05) OR (CASE WHEN f.closed THEN a.n ELSE f.words + a.n END) >= 60
  FROM f JOIN a ON a.doc_id = f.doc_id AND a.i = f.i + 1)
SELECT doc_id, chunk::INT AS chunk_no, count(*)::INT AS sentences, max(words)::INT AS words FROM f GROUP BY doc_id, chunk""")
def q06_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_pages(v.pages(spark, sf_dir), "semantic_breakpoint", size=60, breakpoint=0.05)
    text = F.col("chunk_text")
    return chunks.select("doc_id", "chunk_no", F.size(chunking.sentences(text)).alias("sentences"), F.size(chunking.words(text)).alias("words"))


SPARSE = f"""
t AS (SELECT question_id AS id, unnest({v.tokens("question")}) AS t FROM questions
      UNION ALL SELECT -1 - doc_id AS id, unnest({v.tokens("chunk_text")}) AS t FROM chunks),
g AS (SELECT id, (('0x' || substr(sha1(t), 1, 8))::BIGINT % 256)::INT AS idx,
             CASE WHEN ('0x' || substr(sha1(t), 10, 1))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM t),
w AS (SELECT id, idx, sum(s) AS raw FROM g GROUP BY id, idx HAVING sum(s) <> 0),
e AS (SELECT id, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM w)
"""


@query(f"WITH {v.CHUNKS}, {v.QUESTIONS}, {SPARSE} SELECT -1 - id AS doc_id, idx, round(weight, 6) AS weight FROM e WHERE id < 0")
def q07_hash_embedding_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sparse_embedding(v.table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
d AS (SELECT q.vec_id AS question_id, e.vec_id AS row_idx, sum(q.x * e.x) AS dot FROM e q JOIN e ON q.i = e.i WHERE q.vec_id % 50 = 0 GROUP BY ALL),
s AS (SELECT question_id, row_idx, round(dot / greatest(a.n * b.n, 1e-8), 9) AS score FROM d JOIN n a ON a.vec_id = question_id JOIN n b ON b.vec_id = row_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_idx) AS rank FROM s)
SELECT question_id, rank::INT AS rank, row_idx, round(score, 6) AS score FROM r WHERE rank <= 10""")
def q08_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    e = v.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))
    hits = vectors.cosine_search(asked, e.select(F.col("vec_id").alias("row_idx"), "embedding"), 10)
    return hits.select("question_id", "rank", "row_idx", F.round("score", 6).alias("score"))


VECTOR_HITS = f"""{SPARSE},
s AS (SELECT q.id AS question_id, (-1 - c.id)::VARCHAR AS chunk_id, round(sum(q.weight * c.weight), 9) AS score
      FROM e q JOIN e c ON q.idx = c.idx WHERE q.id >= 0 AND c.id < 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
"""


@query(f"WITH {v.CHUNKS}, {v.QUESTIONS}, {VECTOR_HITS} SELECT question_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 8")
def q09_hash_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.sparse_search(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), 8)
    return hits.select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))
