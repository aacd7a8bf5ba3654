"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source the documents stand in one fixed order, each expects `target / source_size` copies, and a document
is emitted once for every whole number that the running sum of expectations, started at a random offset, crosses.
The order climbs through the sizes for one half of the documents and descends for the other, so that what the offset
adds at the top of the one half it takes away at the top of the other and the words taken stay near the target.

The running sum is never taken over a whole source in one task: a source is cut into blocks (half, size band, salt),
rows are numbered within their block, and the blocks' own counts are summed per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .pivots import of_checked_size

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
#: A source's size band gets one more salt for every so many rows of the input.
ROWS_PER_SALT = 4_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes by weight. A target
    stops at `most` times its source's size; what is over is shared again by weight among the others. That has a
    closed form: in ascending order of limit per weight, a source is held at its limit as long as its part of what the
    sources before it left is no less. The frame has one row for each source; it is small next to the documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.lit(None).cast("long")
    for k, w in reversed(list(enumerate(weights))):
        at = F.when(F.col("__n") % len(weights) == k, F.lit(w).cast("long")).otherwise(at)
    df = sizes.withColumn("__n", F.row_number().over(ordered) - 1).withColumn("__w", at).withColumn("__limit", F.col("source_size") * most)
    rising = Window.orderBy(F.col("__limit") / F.col("__w"), F.col("__n"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = (F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0))).cast("double")
    rest_w = (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))).cast("double")
    df = df.withColumn("__part", rest / rest_w).withColumn("__free", F.col("__limit") > F.col("__part") * F.col("__w"))
    level = F.first(F.when(F.col("__free"), F.col("__part")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), F.col("__limit").cast("double")).otherwise(F.col("__level") * F.col("__w"))
    return df.withColumn("__level", level).withColumn("target", target).select("source", "source_size", "target")


def _unit(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def systematic_copies(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = SEED,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Adds source_size long, target double and copies long to rows that have doc_id, source and size.

    All other columns stay. A null source is a source of its own, the last one. A null size counts as 0; rows of size 0
    are drawn like others and take no words; a source of size 0 has the target 0 and gives no copies. Rows that repeat
    a doc_id are rows of their own; fully equal rows may swap their copies. An empty frame gives an empty frame.
    Columns of these names that the input already has are replaced. Equal inputs give equal outputs, however dealt out.
    """
    kept = [c for c in df.columns if c not in ("source_size", "target", "copies")]
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    half = F.when(F.substring(digest, 1, 1).isin(*"02468ace"), 0).otherwise(1)
    bits = F.bin(size)
    band = F.length(bits) * 32 + F.conv(F.substring(bits, 1, 5), 2, 10).cast("int")
    sizes = df.groupBy("source").agg(F.sum(size).alias("source_size"), F.count("*").alias("__rows"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    salts = F.lit(1 + df.count() // rows_per_salt)
    rows = df.select(
        *kept,
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("__src"),
        half.alias("__half"),
        F.when(half == 0, band).otherwise(-band).alias("__band"),
        (F.conv(F.substring(digest, 2, 7), 16, 10).cast("long") % salts).alias("__salt"),
        digest.alias("__digest"),
        size.alias("__size"),
    )
    block = ["__src", "__half", "__band", "__salt"]
    inside = Window.partitionBy(*block).orderBy("__size", "__digest", "doc_id")
    along = Window.partitionBy("__src").orderBy("__half", "__band", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.count("*").alias("__in")).withColumn("__before", F.coalesce(F.sum("__in").over(along), F.lit(0)))
    named = targets.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))).drop("source")
    blocks = blocks.drop("__in").join(named, "__src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _unit(F.concat(F.lit(seed + "|"), F.col("__src")))
    crossed = lambda n: F.floor(n * rate + offset)
    return (
        rows.withColumn("__at", F.row_number().over(inside))
        .join(blocks, block)
        .withColumn("__at", F.col("__at") + F.col("__before"))
        .withColumn("copies", F.least(crossed(F.col("__at")) - crossed(F.col("__at") - 1), F.lit(most)).cast("long"))
        .select(*kept, "source_size", "target", "copies")
    )


def mixed(df: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each row of `df` as often as it has copies, with the columns it had.

    Where doc_ids differ, only these, sources and sizes go through the windows, and rows find their copies by doc_id.
    """
    keys = written(df.select("doc_id", "source", "size"), "mix-sizes")
    if keys.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        copies = systematic_copies(keys, **how).where(F.col("copies") > 0).select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
        drawn = df.join(of_checked_size(written(copies, "mix-copies")), F.col("doc_id") == F.col("__id"))
    else:
        drawn = systematic_copies(df, **how).where(F.col("copies") > 0).withColumn("__copies", F.col("copies"))
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*df.columns)
