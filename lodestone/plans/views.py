"""The driver's tables as inputs of the engine, in DataFrames and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..operators.graph import CUES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: (chunk_id, doc_id, page, section, chunk_text)."""
    docs = table(spark, sf_dir, "documents")
    section = F.coalesce(F.substring(first_line(F.col("text")), 1, 120), F.lit("Section"))
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id"), F.lit(1).alias("page"), section.alias("section"), F.col("text").alias("chunk_text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the one page of a file of its own."""
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(1).alias("page"), "text")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with cue words as chunks: (chunk_id, chunk_text)."""
    cue = F.element_at(F.array(*[F.lit(c) for c, _ in CUES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.concat_ws(" ", F.col("p_name"), cue, F.concat(F.lower(F.col("p_type")), F.lit(" delivery.")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), text.alias("chunk_text"))


#: The same views as common table expressions, and pieces of SQL that the queries share.
CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR AS chunk_id, doc_id, 1 AS page,
         coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 120), 'Section') AS section,
         text AS chunk_text FROM documents)"""
QUESTIONS = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"
SENTENCES = """sentences AS (
  SELECT 'p' || p_partkey AS chunk_id,
         p_name || ' ' || ['affects', 'influences', 'controls', 'mitigates', 'causes', 'requires', 'uses', 'depends on'][p_partkey % 8 + 1]
         || ' ' || lower(p_type) || ' delivery.' AS chunk_text FROM part)"""
STOP = "'a','an','and','are','as','at','be','by','for','from','how','in','is','it','of','on','or','the','to','what','while','with'"


def tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[a-zA-Z0-9]+'), lambda t: lower(t))"


def words(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def sentence_list(text: str) -> str:
    return f"string_split(regexp_replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def meaningful(text: str) -> str:
    return f"list_filter({tokens(text)}, lambda t: t NOT IN ({STOP}) AND length(t) > 1)"
