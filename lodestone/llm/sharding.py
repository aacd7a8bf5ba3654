"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, and equal texts stay together.

What is packed is a bounded list of items, however many rows there are:

* a group of equal texts that holds more than 1/GROUPS of all bytes, tokens or rows is an item of its own (there are
  at most 3 x GROUPS of these);
* one that holds more than 1/(2 x shards) of any is cut into pieces by doc_id, as whole it could not be balanced;
* all other groups are hashed into BUNDLES bundles, each an item.

The driver places the items, the largest first, each on the shard where the dot product of its size vector with the
shard's residual capacity is highest. Rows find their item by hash and by broadcasting the bounded lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

SHARDS = 24
GROUPS, BUNDLES = 1 << 14, 4096
#: Rows numbered in one task when slots are given.
ROWS_PER_RUN = 500_000
LEAST_RUNS = 16


def packed(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, given each item's share of the totals in every dimension."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int32)
    for k in np.argsort(-vectors.max(axis=1), kind="stable") if len(vectors) else ():
        best = int(np.argmax(residual @ vectors[k]))
        residual[best] -= vectors[k]
        out[k] = best
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, size, tokens, text_crc32, text_key); a null text counts as the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        n_words(text).alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_key"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES, own_items: int = GROUPS) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, shard, slot), a row for each row.

    Null and empty texts are one group of size 8 and no tokens. Rows that repeat a doc_id are rows of their own; a null
    doc_id is placed like any. Further columns don't take part. An empty frame gives an empty frame. Slots number a
    shard's rows from 0 without gaps, in the order of runs that hash doc_id, so no task numbers a whole shard.
    """
    spark = docs.sparkSession
    rows = written(measured(docs), "op6-rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    groups = written(groups, "op6-groups")
    totals = groups.agg(F.sum("b"), F.sum("t"), F.sum("n")).first()
    b, t, n = (float(x or 0) or 1.0 for x in totals)
    share = F.greatest(F.col("b") / b, F.col("t") / t, F.col("n") / n)
    groups = groups.withColumn("share", share)
    pieces = F.when(F.col("share") > 0.5 / shards, F.ceil(F.col("share") * 2 * shards)).otherwise(1).cast("int")
    large = groups.where(F.col("share") > 1.0 / own_items).withColumn("pieces", pieces)
    named = large.select("text_key", "pieces")
    of_bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("text_key"), F.lit(bundles)).cast("string"))
    of_group = F.concat(F.lit("g"), F.hex("text_key"), F.lit("-"), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.col("pieces")).cast("string"))
    # at most 3 x own_items groups are large
    placed = rows.join(F.broadcast(named), "text_key", "left").withColumn("item", F.when(F.col("pieces").isNull(), of_bundle).otherwise(of_group))
    items = placed.groupBy("item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("item").collect()
    vectors = np.array([[r["b"] / b, r["t"] / t, r["n"] / n] for r in items], float).reshape(-1, 3)
    where = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, packed(vectors, shards), strict=True)], "item string, shard int")
    runs = max(LEAST_RUNS, int(n) // (shards * ROWS_PER_RUN))
    # no more items than bundles, large groups and the pieces of those
    dealt = placed.join(F.broadcast(where), "item").withColumn("run", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("slot")), F.lit(runs)).cast("int"))
    along = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "run").agg(F.count("*").alias("in_run")).withColumn("before", F.coalesce(F.sum("in_run").over(along), F.lit(0))).drop("in_run")
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    slots = dealt.withColumn("at", F.row_number().over(inside) - 1).join(before, ["shard", "run"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"))
