"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are rotated by one random orthogonal matrix, so that the partial distance over the first d of D dimensions,
times D / d, estimates the whole. They are put into the lists of their nearest centroids, and each list is cut into
blocks of bounded size that are stored by dimension blocks. A query visits its nearest lists; within one it keeps the
distance of its k-th best so far, and after every dimension block drops the candidates whose estimate exceeds it by
more than a test of the given error allows. What survives is measured on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready_for_python

#: Centroids are fitted on at most so many vectors, the first by a hash of vec_id. Every vector is indexed.
SAMPLE = 20_000
MOST_LISTS = 1024
PROBES = 0.7
#: Vectors of a list that are scanned in one task, and queries that scan them together.
BLOCK = 2048
QUERY_BLOCK = 256
DIMENSIONS_A_STEP = 8
#: A candidate is dropped when its estimated distance is over (1 + ERROR / sqrt(d)) times the k-th best.
ERROR = 2.5
SEED = 11


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) with embedding as array<double>, without null, empty or zero vectors and those with null or
    non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = df.select("vec_id", x.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return out.where(F.forall("embedding", fine)).where(F.exists("embedding", lambda v: v != 0))


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's rounds from random distinct vectors; an empty list takes the vector farthest from its centroid."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        d = squares(sample, c)
        to = d.argmin(axis=1)
        n = np.bincount(to, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, to, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for k, far in zip(np.flatnonzero(n == 0), np.argsort(-d.min(axis=1)), strict=False):
            c[k] = sample[far]
    return c


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def scan(query: np.ndarray, turned: np.ndarray, originals: np.ndarray, turned_query: np.ndarray, own: np.ndarray, k: int, order: np.ndarray, error: float = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of one block: (row numbers, distances), nearest first, ties in the order of rows.

    `turned` is stored by dimension (D x n); `own` marks rows that may not be found; `order` are the rows from the most
    promising on. The first k rows set the bound, the rest is scanned in growing runs.
    """
    dims, n = turned.shape
    rows = order[~own[order]]
    best_i, best_d = np.empty(0, np.int64), np.empty(0)
    at, step = 0, max(64, 4 * k)
    while at < len(rows):
        live, at = rows[at : at + step], at + step
        step *= 2
        if len(best_d) >= k:
            bound, partial = best_d[k - 1] ** 2, np.zeros(len(live))
            for d in range(0, dims, DIMENSIONS_A_STEP):
                block = turned[d : d + DIMENSIONS_A_STEP][:, live] - turned_query[d : d + DIMENSIONS_A_STEP, None]
                partial = partial + (block * block).sum(0)
                seen = min(dims, d + DIMENSIONS_A_STEP)
                slack = (1 + error / np.sqrt(seen)) ** 2 if seen < dims else 1 + 1e-9
                keep = partial * (dims / seen) <= bound * slack
                live, partial = live[keep], partial[keep]
                if not len(live):
                    break
        if len(live):
            exact = np.sqrt(((originals[live] - query) ** 2).sum(1))
            i, d = np.concatenate([best_i, live]), np.concatenate([best_d, exact])
            top = np.lexsort((i, d))[:k]
            best_i, best_d = i[top], d[top]
    return best_i, best_d


def search(df: DataFrame, queries: DataFrame, k: int = 10, probes: float = PROBES, lists: int | None = None) -> DataFrame:
    """(vec_id, embedding) and queries (query_id, embedding) to (query_id, rank, vec_id, score).

    Each query's k nearest of the vectors found in the lists that it visits, by Euclidean distance on the original
    vectors in double precision, ties to the smaller vec_id; a vector whose vec_id is the query's own is no candidate.
    `probes` is the share of lists visited, more than k vectors' worth at least. Vectors and queries that are null or
    zero, or hold null or non-finite components, take no part; neither do vectors of another length than most of the
    sample. Rows that repeat a vec_id are candidates of their own; queries
    that repeat a query_id are answered once for each vector that they have. Without vectors or queries the result is empty.
    """
    spark = df.sparkSession
    ready_for_python(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    vectors, asked = usable(df), usable(queries.withColumnRenamed("query_id", "vec_id")).dropDuplicates(["vec_id", "embedding"])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return spark.createDataFrame([], schema)
    dims = int(pd.Series([len(v) for v in sample]).mode()[0])
    sample = np.stack([v for v in sample if len(v) == dims])
    vectors, asked = (x.where(F.size("embedding") == dims) for x in (vectors, asked))
    total = vectors.count()
    wanted = lists or int(min(MOST_LISTS, max(1, np.sqrt(total) / 4)))
    centres = centroids(sample, wanted)
    turn = rotation(dims)
    visits = int(min(len(centres), max(4, np.ceil(probes * len(centres)), np.ceil(4 * k * len(centres) / max(1, total)))))
    shared = spark.sparkContext.broadcast(centres)  # MOST_LISTS x dimensions at most

    def listed(many: int):
        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            for frame in frames:
                if not len(frame):
                    continue
                near = np.argsort(squares(np.stack(frame["embedding"]), c), axis=1, kind="stable")[:, :many]
                yield pd.DataFrame({"vec_id": np.repeat(frame["vec_id"].to_numpy(), many), "embedding": frame["embedding"].repeat(many).to_numpy(), "list": near.ravel().astype(np.int32)})

        return batches

    indexed = vectors.mapInPandas(listed(1), "vec_id long, embedding array<double>, list int")
    counts = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    blocks = spark.createDataFrame([(k, -(-n // BLOCK)) for k, n in counts.items()], "list int, blocks int")
    # both sides of a block are bounded: its vectors by BLOCK, its queries by reading them a batch of QUERY_BLOCK at a time
    indexed = indexed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    asked_blocks = max(1, -(-asked.count() // (QUERY_BLOCK * 16)))
    copies = asked_blocks
    indexed = indexed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    visited = asked.mapInPandas(listed(visits), "vec_id long, embedding array<double>, list int").join(F.broadcast(blocks), "list")
    visited = visited.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    visited = visited.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(copies)).cast("int")).withColumnRenamed("vec_id", "query_id").withColumn("query", F.xxhash64("embedding"))

    def scanned(found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(queries):
            found = found.sort_values("vec_id", kind="stable")
            ids, originals = found["vec_id"].to_numpy(), np.stack(found["embedding"])
            turned = np.ascontiguousarray((originals @ turn).T)
            q = np.stack(queries["embedding"])
            first = squares(q, originals[: 4 * k])
            rest = np.arange(min(4 * k, len(ids)), len(ids))
            for j, (query_id, one, turned_one) in enumerate(zip(queries["query_id"], q, q @ turn, strict=True)):
                order = np.concatenate([np.argsort(first[j], kind="stable"), rest])
                i, d = scan(one, turned, originals, turned_one, ids == query_id, k, order)
                out.append(pd.DataFrame({"query_id": query_id, "query": queries["query"].iloc[j], "vec_id": ids[i], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    key = ["list", "block", "part"]
    near = indexed.groupBy(*key).cogroup(visited.groupBy(*key)).applyInPandas(scanned, "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
