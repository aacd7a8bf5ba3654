"""Store maintenance: additions without duplicates, removal, counts, retention and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Providers whose vectors any dimension can be had of.
HASHED_PROVIDERS = ("local", "local-hash", "local_hash")


def additions(new: DataFrame, existing: DataFrame, content: str, order: Column) -> DataFrame:
    """The rows of `new` whose content digest the store hasn't, the first of each digest in the order given."""
    hashed = new.withColumn("sha256", F.sha2(F.col(content), 256))
    first = Window.partitionBy("sha256").orderBy(order)
    fresh = hashed.join(existing.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def realigned(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embedding rows of the chunks that are left, numbered anew from 0 in their old order.

    Ranges of the old numbers are counted apart and shifted, so no task numbers all rows.
    """
    left = meta.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("__part", F.floor(F.col("row_idx") / 100_000))
    before = left.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("row_idx")) - 1
    return left.withColumn("__at", place).join(before, "__part").withColumn("row_idx", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def appended(meta: DataFrame, new: DataFrame) -> DataFrame:
    """`new` (row_idx from 0) after `meta`, its numbers going on from the last."""
    last = meta.agg(F.coalesce(F.max("row_idx") + 1, F.lit(0)).alias("__from"))
    return meta.unionByName(new.crossJoin(F.broadcast(last)).withColumn("row_idx", F.col("row_idx") + F.col("__from")).drop("__from"))


def removed(doc_id, *tables: DataFrame) -> list[DataFrame]:
    return [t.where(F.col("doc_id") != doc_id) for t in tables]


def document_removed(doc_id, documents: DataFrame, pages: DataFrame, chunks: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """The tables without a document, its embedding rows left out and the others numbered anew; None if it is unknown."""
    if not documents.where(F.col("doc_id") == doc_id).limit(1).count():
        return None
    documents, pages, chunks = removed(doc_id, documents, pages, chunks)
    return documents, pages, chunks, realigned(meta, chunks)


def aligned(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embedding rows with their chunks, a row for each of `meta`; in the order of row_idx when sorted by it.

    Of chunks with one chunk_id the last in the order of their other columns counts. An embedding row that names a chunk
    that there isn't fails the query that reads it, by a check in its plan.
    """
    others = [c for c in chunks.columns if c != "chunk_id"]
    once = chunks.groupBy("chunk_id").agg(F.max(F.struct(F.lit(1).alias("__is"), *others)).alias("__c"))
    lost = F.raise_error(F.concat(F.lit("embedding metadata names an unknown chunk_id: "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))))
    found = meta.join(once, "chunk_id", "left").where(F.when(F.col("__c").isNull(), lost).otherwise(True))
    return found.select(*meta.columns, *[F.col(f"__c.{c}").alias(c) for c in others if c not in meta.columns])


def kept_sets(runs: DataFrame, keep: DataFrame, keep_latest: int = 3) -> DataFrame:
    """(run_id, state): retained, removable, or missing for a name in `keep` that no run has."""
    marked = retention(runs, keep_latest).join(keep.select("run_id").distinct().withColumn("__k", F.lit(True)), "run_id", "left")
    state = F.when(F.col("retained") | F.coalesce("__k", F.lit(False)), "retained").otherwise("removable")
    missing = keep.select("run_id").distinct().join(runs, "run_id", "left_anti").select("run_id", F.lit("missing").alias("state"))
    return marked.select("run_id", state.alias("state")).unionByName(missing)


def document_counts(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their numbers of pages and chunks, 0 where there are none."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    return documents.join(count(pages, "pages"), "doc_id", "left").join(count(chunks, "chunks"), "doc_id", "left").fillna(0, ["pages", "chunks"])


def summary(documents: DataFrame, pages: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(documents, "documents").crossJoin(one(pages, "pages")).crossJoin(one(chunks, "chunks"))
    if vectors is None or meta is None:
        return out.withColumn("has_embeddings", F.lit(False))
    out = out.crossJoin(one(vectors, "__v")).crossJoin(one(meta, "__m"))
    return out.withColumn("has_embeddings", (F.col("__v") > 0) & (F.col("__v") == F.col("__m"))).drop("__v", "__m")


def retention(runs: DataFrame, keep_latest: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(run_id, mtime) with retained: the latest by mtime, ties by name, and those named."""
    place = F.row_number().over(Window.orderBy(F.desc("mtime"), "run_id"))
    return runs.withColumn("retained", (place <= keep_latest) | F.col("run_id").isin(keep or []))


def integrity(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """What is wrong between chunks and embedding rows: (check, bad) with the number of offending rows or values."""
    missing = meta.join(chunks.select("chunk_id"), "chunk_id", "left_anti").agg(F.lit("unknown_chunk").alias("check"), F.count("*").alias("bad"))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated_chunk").alias("check"), F.count("*").alias("bad"))
    out = missing.unionByName(twice)
    for c in ("provider", "embedding_model", "dim"):
        out = out.unionByName(meta.agg(F.lit(f"mixed_{c}").alias("check"), F.greatest(F.count_distinct(c) - 1, F.lit(0)).alias("bad")))
    return out


def index_problem(embeddings: DataFrame, chunks: DataFrame, provider: str | None = None, model: str | None = None, dim: int | None = None) -> DataFrame:
    """One row (problem): what is wrong with an index (row_idx, chunk_id, embedding, provider, embedding_model, dim) over
    its chunks, and with what the settings say of it; null if nothing is. One aggregate over each table."""
    name = lambda c: F.lower(F.trim(c)) if c == "provider" else F.trim(c)
    mixed = {c: (F.min(name(c)).alias(f"least_{c}"), F.max(name(c)).alias(f"most_{c}")) for c in ("provider", "embedding_model")}
    facts = embeddings.agg(
        F.count("*").alias("rows"), F.count_distinct("row_idx").alias("places"), F.min("row_idx").alias("least_row"), F.max("row_idx").alias("most_row"),
        F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"), F.min(F.size("embedding")).alias("least_size"), F.max(F.size("embedding")).alias("most_size"),
        *[x for pair in mixed.values() for x in pair],
    )
    facts = facts.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # one row and one row
    c = F.col
    differs = lambda found, said: F.lit(False) if said is None else found != F.lit(said)
    of = lambda what, found, said: F.concat(F.lit(f"embedding {what} mismatch between settings and index: {said} != "), found.cast("string"))
    hashed = c("least_provider").isin(*HASHED_PROVIDERS)
    problem = (
        F.when((c("rows") == 0) | (c("chunks") == 0), "missing chunks or embedding metadata")
        .when(c("least_provider") != c("most_provider"), "embedding metadata mixes multiple providers")
        .when(c("least_embedding_model") != c("most_embedding_model"), "embedding metadata mixes multiple embedding models")
        .when(c("least_dim") != c("most_dim"), "embedding metadata mixes multiple dimensions")
        .when((c("places") != c("rows")) | (c("least_row") != 0) | (c("most_row") != c("rows") - 1), "embedding rows aren't numbered from 0 without gaps")
        .when((c("least_size") != c("least_dim")) | (c("most_size") != c("least_dim")), "embedding matrix dimension does not match metadata")
        .when(differs(c("least_provider"), provider and provider.strip().lower()), of("provider", c("least_provider"), provider))
        .when(differs(c("least_embedding_model"), model and model.strip()), of("model", c("least_embedding_model"), model))
        .when(hashed & differs(c("least_dim"), dim), of("dimension", c("least_dim"), dim))
    )
    return facts.select(problem.alias("problem"))


def guarded(rows: DataFrame, problem: DataFrame) -> DataFrame:
    """The same rows; a query that reads any of them fails where the one row (problem) names a problem."""
    checked = rows.crossJoin(F.broadcast(problem.withColumnRenamed("problem", "__problem")))  # of one row
    return checked.where(F.when(F.col("__problem").isNotNull(), F.raise_error(F.col("__problem"))).otherwise(True)).drop("__problem")
