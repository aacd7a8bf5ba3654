"""An index of captioned images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fixed
from . import jobs, vectors


def image_index(captions: DataFrame, dimensions: int = vectors.DIMENSIONS) -> DataFrame:
    """(caption, image_ref, page) to (row_idx, chunk_id, caption, image_ref, page, embedding): images numbered from 0 in the
    order of page, image_ref and caption, chunk_id being img_<row_idx>. A null caption is empty, and has the zero vector."""
    # the numbering of chunks has four keys; a row of ours is told from an equal one by its running number
    rows = captions.select(F.coalesce("caption", F.lit("")).alias("chunk_text"), "image_ref", "page").withColumn("chunk_id", F.monotonically_increasing_id().cast("string"))
    keyed = rows.select("chunk_id", F.lit("").alias("doc_id"), "page", F.concat_ws("\x00", "image_ref", "chunk_text").alias("section"), "chunk_text", "image_ref")
    keyed = fixed(keyed)
    index = jobs.index(keyed, dimensions=dimensions).select("row_idx", F.col("chunk_id").alias("__id"), "embedding")
    out = index.join(keyed.withColumnRenamed("chunk_id", "__id"), "__id")
    return out.select("row_idx", F.concat(F.lit("img_"), F.col("row_idx").cast("string")).alias("chunk_id"), F.col("chunk_text").alias("caption"), "image_ref", "page", "embedding")


def image_search(questions: DataFrame, index: DataFrame, k: int = 5, dimensions: int = vectors.DIMENSIONS) -> DataFrame:
    """(question_id, question) to (question_id, rank, score, chunk_id, caption, image_ref, page) of the k images whose
    captions are nearest, ties to the smaller row_idx. An empty index has no hits."""
    asked = questions.select("question_id", vectors.dense_embedding(F.col("question"), dimensions).alias("query"))
    hits = vectors.cosine_search(asked, index.select("row_idx", "embedding"), k)
    return hits.join(index.drop("embedding"), "row_idx").select("question_id", "rank", "score", "chunk_id", "caption", "image_ref", "page")
