"""Grounded answers: one sentence of each retrieved chunk, a citation for each, and how well the chunk supports it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment, ended, raw_sentences, token_set
from ..sources.shared import fixed
from .retrieval import keep_first
from .vectors import broadcast_if_small

NOTHING = "No supporting evidence found."


def support(sentence: Column, evidence: Column, score: Column, floor: float = 0.05, lexical: float = 0.8, hit: float = 0.2) -> Column:
    """A weighted sum of the share of the sentence's tokens in the evidence and the squashed hit score, rounded."""
    h = F.greatest(F.lit(0.0), score)
    return F.round(F.greatest(F.lit(floor), lexical * containment(token_set(sentence), token_set(evidence)) + hit * h / (1 + h)), 6)


def traced(hits: DataFrame, chunks: DataFrame, max_sentences: int = 3) -> DataFrame:
    """(question_id, no, sentence, chunk_id, doc_id, page, section, support): the first sentence of each hit's chunk.

    A chunk counts once; hits whose chunk is missing or blank are passed over. Hits are found once and, unless they are
    very many, go to where the texts are.
    """
    hits = broadcast_if_small(fixed(keep_first(hits)))
    first = F.get(raw_sentences(F.col("chunk_text")), F.lit(0))
    rows = hits.join(chunks.select("chunk_id", "doc_id", "page", "section", "chunk_text"), "chunk_id")
    rows = rows.withColumn("sentence", ended(first)).where("sentence IS NOT NULL")
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("no") <= max_sentences)
    return rows.select("question_id", "no", "sentence", "chunk_id", "doc_id", "page", "section", support(F.col("sentence"), F.col("chunk_text"), F.col("score")).alias("support"))


def answers(trace: DataFrame) -> DataFrame:
    """(question_id, answer_text, citations): the sentences in order, and the chunks that they come from."""
    rows = trace.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("no", "sentence", "chunk_id"))).alias("rows"))  # max_sentences rows each
    return rows.select("question_id", F.array_join(F.transform("rows", lambda r: r["sentence"]), " ").alias("answer_text"), F.transform("rows", lambda r: r["chunk_id"]).alias("citations"))
