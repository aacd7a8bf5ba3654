"""From raw documents to a deduplicated, mixed and tokenised corpus.

Every stage but the last takes and returns rows of `documents` (doc_id, text, lang, source, n_chars, and whatever
further columns there are); the driver, or `run`, writes each result and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from lodestone.llm.common import n_words, table, written


def passing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. One without a text is rejected."""
    return quality_rules.judged(docs.withColumn("__rows_own", F.struct(*docs.columns))).where("kept").select("__rows_own.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that another line stands for; those that keep no word go, as all they held is elsewhere.

    n_chars follows the text. Documents without doc_id take no part and stay.
    """
    own = docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c in ("n_lines", "n_dropped")})
    left = line_dedup.deduplicated(own).where((F.col("n_dropped") == 0) | (n_words(F.col("text")) > 0))
    n_chars = {"n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    left = left.withColumns(n_chars)
    return left.select(*[F.col(f"__own_{c}" if c in ("n_lines", "n_dropped") else c).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Of its rows that repeat a text too, one stays: the first by the JSON of the other columns.

    Documents without doc_id take no part and stay.
    """
    joined = written(ngram_join.joined(docs), "stage-groups")
    first = joined.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    repeats = not first.where(F.col("rows") > 1).isEmpty()
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    if repeats:
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        own = F.struct(*others, F.lit(0).alias("__"))
        kept = kept.groupBy("doc_id", "text").agg(F.min_by(own, F.to_json(own, {"ignoreNullFields": "false"})).alias("__own"))  # maps have no order
        kept = kept.select(*[F.col(f"__own.{c}" if c in others else c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it is drawn.

    A null text or source counts as `mixing.mixed` says; rows that repeat a doc_id are drawn each for itself; an empty
    frame gives an empty frame.
    """
    own = docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c in ("size", "source_size", "target", "copies")})
    drawn = mixing.mixed(own.withColumn("size", n_words(F.col("text"))))
    return drawn.select(*[F.col(f"__own_{c}" if f"__own_{c}" in own.columns else c).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the tokens of each document of the mix, a row for each row.

    A null text is empty and has no tokens; repeated and null doc_ids keep their rows; an empty frame gives an empty frame.
    """
    ids = bpe.token_ids(docs, bpe.default_vocabulary())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", passing),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: SQL has neither the MinHash candidates of the line stage nor BPE; tests hold a run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
