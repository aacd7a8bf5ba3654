"""Relations, graph and search on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.shared import fixed
from . import views as v
from .registry import query

CUES = "(VALUES (1,'affects','affects'),(2,'influences','influences'),(3,'controls','controls'),(4,'mitigates','mitigates'),(5,'causes','causes'),(6,'requires','requires'),(7,'uses','uses'),(8,'depends on','depends_on')) AS cue(k, cue, relation)"
TRIPLES = f"""{v.SENTENCES},
z AS (SELECT chunk_id, lower(unnest({v.sentence_list("chunk_text")})) AS s FROM sentences),
y AS (SELECT row_number() OVER () AS n, * FROM z),
x AS (SELECT n, chunk_id, relation, {v.meaningful("substr(s, 1, strpos(s, cue) - 1)")} AS l, {v.meaningful("substr(s, strpos(s, cue) + length(cue))")} AS r
      FROM y, {CUES} WHERE strpos(s, cue) > 0),
p AS (SELECT n, chunk_id, array_to_string(l[greatest(len(l) - 2, 1):len(l)], ' ') AS source, relation, array_to_string(r[1:3], ' ') AS target FROM x WHERE len(l) > 0 AND len(r) > 0),
f AS (SELECT * FROM p WHERE source <> target),
o AS (SELECT chunk_id, {v.meaningful("s")} AS t FROM y WHERE n NOT IN (SELECT n FROM f)),
g AS (SELECT chunk_id, array_to_string(t[1:2], ' ') AS source, 'related_to' AS relation, array_to_string(t[len(t) - 1:len(t)], ' ') AS target FROM o WHERE len(t) >= 4),
t AS (SELECT chunk_id, source, relation, target FROM f UNION ALL SELECT * FROM g WHERE source <> target),
triples AS (SELECT *, 'node_' || substr(sha1(source), 1, 12) AS source_node_id, 'node_' || substr(sha1(target), 1, 12) AS target_node_id FROM t),
ends AS (SELECT chunk_id, source_node_id AS node_id, source AS name FROM triples UNION ALL SELECT chunk_id, target_node_id, target FROM triples),
nodes AS (SELECT node_id, min(name) AS canonical_name, count(*) AS n FROM ends GROUP BY node_id),
edges AS (
  SELECT 'edge_' || substr(sha1(source_node_id || '|' || relation || '|' || target_node_id), 1, 14) AS edge_id, source_node_id, relation, target_node_id,
         count(*)::DOUBLE AS weight, list_sort(list(DISTINCT chunk_id)) AS evidence
  FROM triples GROUP BY source_node_id, relation, target_node_id)
"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triples(v.sentences(spark, sf_dir))


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, fixed, as a search reads them several times."""
    t = found(spark, sf_dir)
    return fixed(graph.nodes(t)), fixed(graph.edges(t))


@query(f"WITH {TRIPLES} SELECT chunk_id, source, relation, target, source_node_id, target_node_id FROM triples")
def q10_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("chunk_id", "source", "relation", "target", "source_node_id", "target_node_id")


@query(f"WITH {TRIPLES} SELECT node_id, canonical_name, round(least(1.0::DOUBLE, 0.55::DOUBLE + 0.05::DOUBLE * n), 6) AS confidence FROM nodes")
def q11_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(found(spark, sf_dir)).select("node_id", "canonical_name", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {TRIPLES} SELECT edge_id, source_node_id, relation, target_node_id, weight, array_to_string(evidence, ',') AS evidence FROM edges")
def q12_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.edges(found(spark, sf_dir))
    return e.withColumn("evidence", F.array_join("evidence_chunk_ids", ",")).drop("evidence_chunk_ids")


@query(f"WITH {TRIPLES} SELECT chunk_id, node_id, count(*)::INT AS mention_count FROM ends GROUP BY ALL")
def q13_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(found(spark, sf_dir))


ASKED = """asked AS (SELECT s_suppkey AS question_id, 'What ' || p_name || ' ' || lower(p_type) || ' has?' AS question
  FROM supplier JOIN part ON s_suppkey = p_partkey)"""
WALK = f"""{TRIPLES}, {ASKED},
qt AS (SELECT DISTINCT question_id, unnest({v.tokens("question")}) AS t FROM asked),
nt AS (SELECT DISTINCT node_id, canonical_name, unnest({v.tokens("canonical_name")}) AS t FROM nodes),
sc AS (SELECT question_id, node_id, canonical_name, count(*) AS score FROM qt JOIN nt USING (t) GROUP BY ALL),
sd AS (SELECT question_id, node_id FROM sc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, canonical_name) <= 4),
st AS (SELECT * FROM sd UNION ALL SELECT question_id, (SELECT arg_min(node_id, canonical_name) FROM nodes) FROM asked WHERE question_id NOT IN (SELECT question_id FROM sd)),
rc AS (SELECT question_id, node_id, 0 AS depth FROM st UNION SELECT question_id, target_node_id, 1 FROM st JOIN edges ON node_id = source_node_id),
md AS (SELECT question_id, node_id, min(depth) AS depth FROM rc GROUP BY ALL),
walk AS (SELECT question_id, edge_id, depth + 1 AS depth FROM md JOIN edges ON node_id = source_node_id),
ev AS (SELECT question_id, depth, weight, unnest(evidence) AS chunk_id FROM walk JOIN edges USING (edge_id)),
gs AS (SELECT question_id, chunk_id, round(sum(weight / depth), 9) AS score, min(depth) AS depth FROM ev GROUP BY ALL),
graph_hits AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, depth, chunk_id) AS rank FROM gs)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every supplier, as in ASKED."""
    s = v.table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("What "), F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" has?"))
    return s.join(v.table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("question_id"), text.alias("question"))


@query(f"WITH {WALK} SELECT question_id, edge_id, depth::INT AS depth FROM walk")
def q14_bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = found(spark, sf_dir)
    return graph.walked(asked(spark, sf_dir), graph.nodes(t), graph.edges(t), 2)


@query(f"WITH {WALK} SELECT question_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM graph_hits WHERE rank <= 8")
def q15_graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_search(asked(spark, sf_dir), *built(spark, sf_dir), 8).withColumn("score", F.round("score", 6))


@query(f"WITH {TRIPLES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, node_id FROM ends)) AS mentions")
def q15b_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = found(spark, sf_dir)
    return graph.counts(graph.nodes(t), graph.edges(t), graph.mentions(t))
