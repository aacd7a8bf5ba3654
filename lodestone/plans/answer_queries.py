"""Fusion, grounded answers, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answer, evaluate, graph, retrieval, vectors
from ..sources.shared import fixed
from . import views as v
from .graph_queries import WALK, asked, built
from .registry import query
from .search_queries import LEXICAL, VECTOR_HITS


def vector_hits(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    return vectors.sparse_search(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), k)


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed-vector and lexical rankings, fused."""
    lexical = retrieval.lexical_search(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), 8)
    lexical = lexical.withColumn("score", F.round("score", 9))
    return retrieval.fused(vector_hits(spark, sf_dir), lexical, 8)


HYBRID = f"""
WITH {v.CHUNKS}, {v.QUESTIONS}, {VECTOR_HITS.replace("r AS (", "vr AS (")},
a AS (SELECT question_id, chunk_id, score, rank FROM vr WHERE rank <= 8),
{LEXICAL.split(v.QUESTIONS + ",")[1].replace("q AS", "lq AS").replace("c AS", "lc AS").replace("FROM q, c", "FROM lq, lc").replace("s AS (SELECT question_id, chunk_id, len", "ls AS (SELECT question_id, chunk_id, len").replace("FROM s)", "FROM ls)").replace("j AS", "lj AS").replace("FROM j)", "FROM lj)").replace("r AS (SELECT *", "lr AS (SELECT *")},
b AS (SELECT question_id, chunk_id, round(score, 9) AS score, rank FROM lr WHERE rank <= 8),
f AS (
  SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
         greatest(0, coalesce(a.score, 0)) AS vs, greatest(0, coalesce(b.score, 0)) AS gs, a.rank AS ar, b.rank AS br
  FROM a FULL JOIN b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id),
h AS (
  SELECT *, 0.6::DOUBLE * vs + 0.4::DOUBLE * gs AS score,
         row_number() OVER (PARTITION BY question_id ORDER BY 0.6::DOUBLE * vs + 0.4::DOUBLE * gs DESC, vs DESC, gs DESC, ar NULLS LAST, br NULLS LAST, chunk_id) AS rank FROM f),
hits AS (SELECT question_id, rank, chunk_id, score, vs, gs FROM h WHERE rank <= 8)
"""


@query(HYBRID + "SELECT question_id, rank::INT AS rank, chunk_id, round(score, 6) AS score, round(vs, 6) AS vector_score, round(gs, 6) AS graph_score FROM hits")
def q16_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_hits(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("score", "vector_score", "graph_score")})


GRAPH_FUSED = f"""
WITH {WALK},
qt2 AS (SELECT question_id, list_distinct({v.tokens("question")}) AS a FROM asked),
ct2 AS (SELECT chunk_id, list_distinct({v.tokens("chunk_text")}) AS b FROM sentences),
lx AS (SELECT question_id, chunk_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS score FROM qt2, ct2),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM lx) WHERE rank <= 8),
fb AS (SELECT * FROM graph_hits WHERE rank <= 8),
ff AS (
  SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
         greatest(0, coalesce(a.score, 0)) AS vs, greatest(0, coalesce(b.score, 0)) AS gs, a.rank AS ar, b.rank AS br
  FROM fa a FULL JOIN fb b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id),
hh AS (
  SELECT *, 0.6::DOUBLE * vs + 0.4::DOUBLE * gs AS score,
         row_number() OVER (PARTITION BY question_id ORDER BY 0.6::DOUBLE * vs + 0.4::DOUBLE * gs DESC, vs DESC, gs DESC, ar NULLS LAST, br NULLS LAST, chunk_id) AS rank FROM ff)
SELECT question_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM hh WHERE rank <= 8"""


@query(GRAPH_FUSED)
def q17_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_fused(spark, sf_dir, asked(spark, sf_dir))


def graph_fused(spark: SparkSession, sf_dir: str, q: DataFrame) -> DataFrame:
    lexical = retrieval.lexical_search(q, v.sentences(spark, sf_dir), 8).withColumn("score", F.round("score", 9))
    walked = graph.graph_search(q, *built(spark, sf_dir), 8)
    return retrieval.fused(lexical, walked, 8).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


TRACE = HYBRID.rstrip() + f""",
se AS (
  SELECT question_id, rank, h.chunk_id, h.score, chunk_text,
         list_filter(string_split(regexp_replace(trim(chunk_text, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[1] AS s
  FROM hits h JOIN chunks c ON h.chunk_id = c.chunk_id),
en AS (SELECT *, CASE WHEN regexp_matches(trim(s), '[.!?]$') THEN trim(s) ELSE trim(s) || '.' END AS sentence,
              row_number() OVER (PARTITION BY question_id ORDER BY rank) AS no FROM se WHERE s IS NOT NULL),
tk AS (SELECT *, list_distinct({v.tokens("sentence")}) AS st, list_distinct({v.tokens("chunk_text")}) AS ct FROM en WHERE no <= 3),
trace AS (
  SELECT question_id, no, sentence, chunk_id,
         round(greatest(0.05::DOUBLE, 0.8::DOUBLE * (CASE WHEN len(st) = 0 THEN 0 ELSE len(list_intersect(st, ct))::DOUBLE / len(st) END)
               + 0.2::DOUBLE * greatest(0, score) / (1 + greatest(0, score))), 6) AS support FROM tk)
"""


@query(TRACE + "SELECT question_id, string_agg(sentence, ' ' ORDER BY no) AS answer_text, string_agg(chunk_id, ',' ORDER BY no) AS citations FROM trace GROUP BY question_id")
def q18_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = answer.traced(hybrid_hits(spark, sf_dir), v.chunks(spark, sf_dir))
    return answer.answers(trace).withColumn("citations", F.array_join("citations", ","))


@query(TRACE + "SELECT question_id, no::INT AS no, sentence, chunk_id, round(support, 5) AS support FROM trace")
def q19_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = answer.traced(hybrid_hits(spark, sf_dir), v.chunks(spark, sf_dir))
    return trace.select("question_id", "no", "sentence", "chunk_id", F.round("support", 5).alias("support"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's text."""
    return evaluate.holding(v.chunks(spark, sf_dir), v.questions(spark, sf_dir))


GOLD = "gold AS (SELECT DISTINCT question_id, chunk_id FROM questions, chunks WHERE contains(chunk_text, question))"
RANKING = HYBRID.rstrip() + f""", {GOLD},
gn AS (SELECT question_id, count(*) AS n FROM gold GROUP BY question_id),
fd AS (SELECT h.question_id, count(*) AS found, sum(1 / log2(h.rank + 1)) AS dcg FROM hits h JOIN gold USING (question_id, chunk_id) GROUP BY h.question_id),
rm AS (
  SELECT questions.question_id, coalesce(coalesce(found, 0)::DOUBLE / n, 0) AS recall,
         coalesce(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 8) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg
  FROM questions LEFT JOIN gn USING (question_id) LEFT JOIN fd USING (question_id))
"""


@query(RANKING + "SELECT question_id, round(recall, 6) AS recall FROM rm")
def q20_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.ranking_metrics(hybrid_hits(spark, sf_dir), gold(spark, sf_dir), 8, v.questions(spark, sf_dir))
    return m.select("question_id", F.round("recall", 6).alias("recall"))


@query(RANKING + "SELECT question_id, round(ndcg, 6) AS ndcg FROM rm")
def q21_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.ranking_metrics(hybrid_hits(spark, sf_dir), gold(spark, sf_dir), 8, v.questions(spark, sf_dir))
    return m.select("question_id", F.round("ndcg", 6).alias("ndcg"))


@query(TRACE.rstrip() + f""", {GOLD}
SELECT t.question_id, round(count(g.chunk_id)::DOUBLE / count(*), 6) AS precision
FROM (SELECT DISTINCT question_id, chunk_id FROM trace) t LEFT JOIN gold g ON g.question_id = t.question_id AND g.chunk_id = t.chunk_id GROUP BY t.question_id""")
def q22_citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = answer.traced(hybrid_hits(spark, sf_dir), v.chunks(spark, sf_dir))
    return evaluate.citation_precision(trace, gold(spark, sf_dir)).withColumn("precision", F.round("precision", 6))


FAITH = TRACE.rstrip() + f""",
aw AS (SELECT question_id, list_distinct({v.tokens("string_agg(sentence, ' ' ORDER BY no)")}) AS a FROM trace GROUP BY question_id),
ev2 AS (SELECT question_id, list_distinct(flatten(list({v.tokens("chunk_text")}))) AS e FROM trace JOIN chunks USING (chunk_id) GROUP BY question_id),
fa AS (SELECT question_id, len(list_intersect(a, e))::DOUBLE / len(a) AS faithfulness FROM aw JOIN ev2 USING (question_id))
"""


@query(FAITH + "SELECT question_id, round(faithfulness, 6) AS faithfulness FROM fa")
def q23_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = v.chunks(spark, sf_dir)
    trace = fixed(answer.traced(hybrid_hits(spark, sf_dir), chunks))
    return evaluate.faithfulness(answer.answers(trace), trace, chunks).withColumn("faithfulness", F.round("faithfulness", 6))


@query(FAITH.rstrip() + "," + RANKING.removeprefix(HYBRID.rstrip() + ",").rstrip() + """,
pr AS (SELECT t.question_id, count(g.chunk_id)::DOUBLE / count(*) AS precision
  FROM (SELECT DISTINCT question_id, chunk_id FROM trace) t LEFT JOIN gold g ON g.question_id = t.question_id AND g.chunk_id = t.chunk_id GROUP BY t.question_id)
SELECT round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(coalesce(precision, 0)), 6) AS precision, round(avg(coalesce(faithfulness, 0)), 6) AS faithfulness
FROM rm LEFT JOIN pr USING (question_id) LEFT JOIN fa USING (question_id)""")
def q24_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits = v.chunks(spark, sf_dir), fixed(hybrid_hits(spark, sf_dir))  # k rows for each question
    trace = fixed(answer.traced(hits, chunks))
    m = evaluate.query_metrics(v.questions(spark, sf_dir), hits, gold(spark, sf_dir), trace, answer.answers(trace), chunks, 8)
    names = ("recall", "ndcg", "precision", "faithfulness")
    return evaluate.averaged(m, *names).withColumns({c: F.round(c, 6) for c in names})


AXES = (["fixed", "heading_recursive", "sentence_window", "semantic_breakpoint"], ["hash-small", "hash-base", "hash-large"], ["vector", "graph", "hybrid"])
GRID = """
ch AS (SELECT unnest(['fixed', 'heading_recursive', 'sentence_window', 'semantic_breakpoint']) AS chunking),
em AS (SELECT unnest(['hash-small', 'hash-base', 'hash-large']) AS embedding),
rt AS (SELECT unnest(['vector', 'graph', 'hybrid']) AS retrieval),
ex AS (SELECT *, 'exp_' || lower(trim(regexp_replace(chunking, '[^a-zA-Z0-9]+', '_', 'g'), '_')) || '_' || lower(trim(regexp_replace(embedding, '[^a-zA-Z0-9]+', '_', 'g'), '_'))
       || '_' || retrieval AS exp_id FROM ch, em, rt)
"""


@query(f"WITH {GRID} SELECT exp_id, chunking, embedding, retrieval FROM ex")
def q25_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grid(spark, *AXES).select("exp_id", "chunking", "embedding", "retrieval")


MATRIX = f"""
WITH {v.CHUNKS}, {v.QUESTIONS}, {GRID}, {GOLD},
qt AS (SELECT question_id, list_distinct({v.tokens("question")}) AS q FROM questions),
ct AS (SELECT chunk_id, doc_id, page, section, list_distinct({v.tokens("chunk_text")}) AS t, list_distinct({v.tokens("section")}) AS s FROM chunks),
ji AS (SELECT question_id, chunk_id, doc_id, page, section, len(list_intersect(q, t)) AS it, len(q) + len(t) AS ut, len(list_intersect(q, s)) AS si, len(q) + len(s) AS us FROM qt, ct),
jj AS (SELECT *, CASE WHEN ut - it = 0 THEN 0 ELSE it::DOUBLE / (ut - it) END AS ts, CASE WHEN us - si = 0 THEN 0 ELSE si::DOUBLE / (us - si) END AS ss FROM ji),
sv AS (SELECT question_id, chunk_id, doc_id, page, section, round(0.75::DOUBLE * ts + 0.25::DOUBLE * ss, 12) AS score FROM jj),
sg AS (SELECT question_id, chunk_id, doc_id, page, section, round(0.55::DOUBLE * ts + 0.45::DOUBLE * ss, 12) AS score FROM jj),
tv AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page, section, chunk_id) AS rank FROM sv) WHERE rank <= 10),
tg AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, page, section, chunk_id) AS rank FROM sg) WHERE rank <= 10),
sc AS (SELECT *, 1.0::DOUBLE + ('0x' || substr(sha1(chunking), 1, 6))::BIGINT % 11 * 0.001::DOUBLE AS cs, 1.0::DOUBLE + ('0x' || substr(sha1(embedding), 1, 6))::BIGINT % 11 * 0.001::DOUBLE AS es FROM ex),
hv AS (SELECT exp_id, question_id, chunk_id, rank, round(score * (cs * es), 12) AS score FROM sc, tv WHERE retrieval = 'hybrid'),
hg AS (SELECT exp_id, question_id, chunk_id, rank, round(score * cs, 12) AS score FROM sc, tg WHERE retrieval = 'hybrid'),
hf AS (
  SELECT coalesce(a.exp_id, b.exp_id) AS exp_id, coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
         coalesce(a.score, 0) AS vs, coalesce(b.score, 0) AS gs, a.rank AS ar, b.rank AS br
  FROM hv a FULL JOIN hg b ON a.exp_id = b.exp_id AND a.question_id = b.question_id AND a.chunk_id = b.chunk_id),
hh AS (SELECT exp_id, question_id, chunk_id,
  row_number() OVER (PARTITION BY exp_id, question_id ORDER BY 0.6::DOUBLE * vs + 0.4::DOUBLE * gs DESC, vs DESC, gs DESC, ar NULLS LAST, br NULLS LAST, chunk_id) AS rank FROM hf),
mh AS (
  SELECT exp_id, question_id, rank, chunk_id FROM ex, tv WHERE retrieval = 'vector'
  UNION ALL SELECT exp_id, question_id, rank, chunk_id FROM ex, tg WHERE retrieval = 'graph'
  UNION ALL SELECT exp_id, question_id, rank, chunk_id FROM hh WHERE rank <= 10),
gn AS (SELECT question_id, count(*) AS n FROM gold GROUP BY question_id),
fd AS (SELECT exp_id, question_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM mh JOIN gold USING (question_id, chunk_id) GROUP BY ALL),
mm AS (
  SELECT ex.exp_id, coalesce(coalesce(found, 0)::DOUBLE / n, 0) AS recall,
         coalesce(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg
  FROM ex CROSS JOIN questions q LEFT JOIN gn ON gn.question_id = q.question_id LEFT JOIN fd ON fd.exp_id = ex.exp_id AND fd.question_id = q.question_id),
mx AS (SELECT exp_id, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM mm GROUP BY exp_id)
"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    experiments = evaluate.grid(spark, *AXES)
    base = fixed(evaluate.base_candidates(v.questions(spark, sf_dir), v.chunks(spark, sf_dir), 10))
    hits = evaluate.matrix_hits(base, experiments, 10)
    pair = lambda df: df.withColumn("question_id", F.concat_ws("|", "exp_id", F.col("question_id").cast("string")))
    wanted = pair(experiments.select("exp_id").crossJoin(fixed(gold(spark, sf_dir))))
    every = pair(experiments.select("exp_id").crossJoin(v.questions(spark, sf_dir).select("question_id")))
    m = evaluate.ranking_metrics(pair(hits), wanted, 10, every).withColumn("exp_id", F.substring_index("question_id", "|", 1))
    return m.groupBy("exp_id").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(MATRIX + "SELECT exp_id, recall, ndcg FROM mx")
def q26_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(MATRIX + "SELECT exp_id, recall, ndcg, (row_number() OVER (ORDER BY ndcg DESC, recall DESC, exp_id))::INT AS place FROM mx")
def q27_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaderboard(matrix(spark, sf_dir))


@query("""
WITH m AS (SELECT * FROM (VALUES (0, 'fact', 0.45::DOUBLE), (1, 'multi_hop', 0.35::DOUBLE), (2, 'contrast', 0.20::DOUBLE)) AS t(k, type, w)),
s AS (SELECT size, k, type, w / 1.0::DOUBLE * size AS share FROM m, (VALUES (200), (20), (33)) AS z(size)),
f AS (SELECT *, floor(share) AS n, row_number() OVER (PARTITION BY size ORDER BY share - floor(share) DESC, k) AS place, size - sum(floor(share)) OVER (PARTITION BY size) AS rest FROM s)
SELECT size, type, (n + CASE WHEN place <= rest THEN 1 ELSE 0 END)::INT AS n FROM f""")
def q28_type_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [evaluate.type_targets(spark, n).select(F.lit(n).alias("size"), "type", F.col("n").cast("int").alias("n")) for n in (200, 20, 33)]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def _excerpt(text: str, n: int) -> str:
    return f"(CASE WHEN len(regexp_extract_all({text}, '[a-zA-Z0-9]+')) = 0 THEN '' ELSE array_to_string(regexp_extract_all({text}, '[a-zA-Z0-9]+')[1:{n}], ' ') || '.' END)"


@query(f"""
WITH {v.CHUNKS},
c AS (SELECT *, coalesce(nullif(trim(regexp_replace(section, '\\s+', ' ', 'g')), ''), 'Unknown Section') AS s,
      row_number() OVER (ORDER BY doc_id, page, section, chunk_id) - 1 AS at, count(*) OVER () AS n FROM chunks),
k AS (SELECT * FROM (VALUES ('fact', 90, 1), ('multi_hop', 70, 1), ('contrast', 40, 2)) AS t(type, cnt, stride)),
d AS (SELECT type, unnest(range(0, cnt)) AS idx, stride FROM k),
p AS (SELECT type, idx, idx % n AS one, CASE WHEN n = 1 THEN 0 ELSE (idx + ((idx // n) % (n - 1) + 1) * stride) % n END AS two FROM d, (SELECT count(*) AS n FROM chunks))
SELECT idx, type, a.chunk_id AS first_chunk, CASE WHEN type <> 'fact' THEN b.chunk_id END AS second_chunk,
       CASE type WHEN 'fact' THEN {_excerpt("a.chunk_text", 22)}
                 WHEN 'multi_hop' THEN trim({_excerpt("a.chunk_text", 12)} || ' ' || {_excerpt("b.chunk_text", 12)})
                 ELSE trim(a.s || ' focuses on ' || {_excerpt("a.chunk_text", 10)} || ' while ' || b.s || ' emphasizes ' || {_excerpt("b.chunk_text", 10)}) END AS gold_answer
FROM p JOIN c a ON a.at = one JOIN c b ON b.at = two""".replace("AS at,", "AS pos,").replace("a.at =", "a.pos =").replace("b.at =", "b.pos ="))
def q29_question_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = v.chunks(spark, sf_dir)
    places = evaluate.numbered(chunks)
    parts = [evaluate.question_pairs(spark, chunks, kind, n, places) for kind, n in (("fact", 90), ("multi_hop", 70), ("contrast", 40))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("question")


@query(f"""
WITH {v.CHUNKS},
c AS (SELECT *, coalesce(nullif(trim(regexp_replace(section, '\\s+', ' ', 'g')), ''), 'Unknown Section') AS s,
      row_number() OVER (ORDER BY doc_id, page, section, chunk_id) - 1 AS pos FROM chunks),
k AS (SELECT * FROM (VALUES (0, 'fact', 90, 1), (1, 'multi_hop', 70, 1), (2, 'contrast', 40, 2)) AS t(k, type, cnt, stride)),
d AS (SELECT k, type, unnest(range(0, cnt)) AS idx, stride FROM k),
p AS (SELECT k, type, idx, idx % n AS one, CASE WHEN n = 1 THEN 0 ELSE (idx + ((idx // n) % (n - 1) + 1) * stride) % n END AS two FROM d, (SELECT count(*) AS n FROM chunks)),
q AS (
  SELECT p.k, type, idx, CASE k * 3 + idx % 3
    WHEN 0 THEN 'What does ' || a.doc_id || ' page ' || a.page || ' describe in the ''' || a.s || ''' section?'
    WHEN 1 THEN 'According to ''' || a.s || ''' in ' || a.doc_id || ', what is the key point?'
    WHEN 2 THEN 'Which detail is stated in ' || a.doc_id || ' p' || a.page || ' under ''' || a.s || '''?'
    WHEN 3 THEN 'How does ''' || a.s || ''' in ' || a.doc_id || ' connect to ''' || b.s || ''' in ' || b.doc_id || '?'
    WHEN 4 THEN 'What relationship links ' || a.doc_id || ' p' || a.page || ' ''' || a.s || ''' with ' || b.doc_id || ' p' || b.page || ' ''' || b.s || '''?'
    WHEN 5 THEN 'Using both ''' || a.s || ''' and ''' || b.s || ''', what combined conclusion is supported?'
    WHEN 6 THEN 'Contrast ''' || a.s || ''' from ' || a.doc_id || ' with ''' || b.s || ''' from ' || b.doc_id || '.'
    WHEN 7 THEN 'How does ' || a.doc_id || ' p' || a.page || ' ''' || a.s || ''' differ from ' || b.doc_id || ' p' || b.page || ' ''' || b.s || '''?'
    ELSE 'What is the main contrast between ''' || a.s || ''' and ''' || b.s || '''?' END AS question
  FROM p JOIN c a ON a.pos = one JOIN c b ON b.pos = two),
u AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) ORDER BY k, idx) AS seen, row_number() OVER (ORDER BY k, idx) AS n FROM q)
SELECT 'run:q' || lpad(n::VARCHAR, 4, '0') AS question_id, type, CASE WHEN seen = 1 THEN question ELSE question || ' (' || (idx + 1) || ')' END AS question FROM u""")
def q29b_question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.generated_questions(spark, v.chunks(spark, sf_dir), "run", 200).select("question_id", "type", "question")


@query("""
WITH s AS (SELECT 'v' || (o_orderkey % 2) AS variant, o_totalprice / 1000 AS score FROM orders),
g AS (SELECT variant, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, var_samp(score) AS v FROM s GROUP BY variant),
b AS (SELECT a.variant AS variant_a, b.variant AS variant_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b, a.std AS std_a, b.std AS std_b,
             a.v / a.n AS ea, b.v / b.n AS eb FROM g a JOIN g b ON a.variant < b.variant),
w AS (SELECT *, abs(mean_a - mean_b) / sqrt(ea + eb) AS ta, (ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)) AS f FROM b),
p AS (SELECT *, lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) AS c FROM w)
SELECT variant_a, variant_b, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a, round(std_b, 6) AS std_b,
       round((mean_a - mean_b) / sqrt(ea + eb), 6) AS t, round((ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)), 4) AS df,
       round(1 - 2 * ta / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(c - (f + 1) / 2 * ln(1 + (i * ta / 2000) * (i * ta / 2000) / f)))), 6) AS p_value,
       CASE WHEN mean_a > mean_b THEN variant_a WHEN mean_b > mean_a THEN variant_b END AS winner FROM p""")
def q30_ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    s = evaluate.compared(orders.select(F.concat(F.lit("v"), (F.col("o_orderkey") % 2).cast("string")).alias("variant"), (F.col("o_totalprice") / 1000).alias("score")))
    return s.withColumns({c: F.round(c, 4 if c == "df" else 6) for c in ("mean_a", "mean_b", "std_a", "std_b", "t", "df", "p_value")})


@query("""
WITH q AS (SELECT o_custkey AS question_id, coalesce(max(o_totalprice) FILTER (o_orderkey % 2 = 0), 0) / 1000 AS a, coalesce(max(o_totalprice) FILTER (o_orderkey % 2 = 1), 0) / 1000 AS b FROM orders GROUP BY 1),
s AS (SELECT a, b FROM q UNION ALL SELECT a, b FROM q)
SELECT 'even' AS variant_a, 'odd' AS variant_b, count(*) AS n_a, count(*) AS n_b, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(stddev_pop(a), 6) AS std_a, round(stddev_pop(b), 6) AS std_b,
       CASE WHEN avg(a) > avg(b) THEN 'even' WHEN avg(b) > avg(a) THEN 'odd' END AS winner FROM s""")
def q30b_ab_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over each customer's largest order with an even and with an odd key; one without such an order scores 0."""
    variant = F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")
    rows = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question_id"), variant.alias("variant")).agg((F.max("o_totalprice") / 1000).alias("score"))
    s = evaluate.compared(evaluate.ab_runs(lambda run: rows, ("even", "odd"), 2))
    return s.drop("t", "df", "p_value").withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "std_a", "std_b")})
