"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds over at most so many links (16 bytes each) run in one task, without a shuffle.
ONE_TASK = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, label): each node of a link with the smallest node of its component.

    Links have no direction; repeated ones and those of a node with itself do no harm, those with a null end are left
    out. Each round is written to the shared folder, and rounds go on until one changes nothing. Minima are taken by
    aggregation with partial results in each task, so a node with very many links needs no room in any of them.
    """
    a, b = F.col("a"), F.col("b")
    known = written(links.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    # a round never has more links than the one before it
    together = (lambda df: df.coalesce(1)) if known.count() <= ONE_TASK else (lambda df: df)
    known = together(known)
    selves, edges = known.where("u = v").select("u"), known.where("u > v")
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v")
        edges = together(written(together(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct(), "links"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    alone = selves.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres).unionByName(alone)
    return together(labels).groupBy("node").agg(F.min("label").alias("label"))
