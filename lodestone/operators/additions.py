"""Documents added to and removed from a store: batches and streams of files become rows of all its tables at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import FILE_SCHEMA, PageParser, described, raw_pages
from ..sources.shared import fixed
from ..sources.stores import Manifest, Store
from . import chunking, jobs
from .observability import Log, Metrics
from .store import realigned
from .vectors import DIMENSIONS, broadcast_if_small

#: Parts of a table after which an addition makes one of them.
MOST_PARTS = 64


@dataclass(frozen=True)
class Added:
    """How much an addition brought: files with new content, their pages and chunks, and files skipped as known."""

    documents: int = 0
    pages: int = 0
    chunks: int = 0
    skipped_duplicates: int = 0


def unknown(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Of files (path, sha256, ...) the first by path of each content that `documents` hasn't."""
    first = Window.partitionBy("sha256").orderBy("path")
    fresh = found.join(documents.select("sha256").distinct(), "sha256", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def index_of(embeddings: DataFrame) -> tuple[str, str, int] | None:
    """(provider, model, dimensions) of a store's embeddings; None without rows. More than one of any is an error."""
    names = ("provider", "embedding_model", "dim")
    row = embeddings.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in enumerate((F.min, F.max))]).first()
    for c in names:
        if row[f"{c}_0"] != row[f"{c}_1"]:
            raise ValueError(f"embeddings mix more than one {c}")
    return None if row["provider_0"] is None else tuple(row[f"{c}_0"] for c in names)


@contextmanager
def stage(name: str, metrics: Metrics | None, log: Log | None) -> Iterator[dict[str, float]]:
    """Writes a stage's seconds, and the counts that are put into what it yields, to `metrics`, and its start and end to
    `log`; after an error too."""
    counts: dict[str, float] = {}
    if log:
        log.info(name, "start")
    with metrics.timer(name) if metrics else nullcontext() as inside:
        try:
            yield counts
        except Exception as error:
            if log:
                log.error(name, "failed", error=str(error)[:2000])
            raise
        if inside:
            for c, n in counts.items():
                inside.counter(c, n)
    if log:
        log.info(name, "complete", **{c.split(".")[0]: n for c, n in counts.items()})


def add(store: Store, found: DataFrame, parser: PageParser | None = None, strategy: str | None = None, mark: tuple[str, int] | None = None, dimensions: int = DIMENSIONS, metrics: Metrics | None = None, log: Log | None = None, **sizes) -> Added:
    """Files (path, content, ...) become rows of the store's documents, pages, chunks and embeddings, by one commit.

    A file whose content the store has, or an earlier path of `found` has, is skipped and counted. The strategy is that
    of the chunks that there are, else the one given. New embeddings go on with the numbers, model and dimensions of
    those that there are; where chunks have none yet, all are embedded. With a mark (source, number) an addition that
    has been made is not made again. What fails before the commit leaves the store as it was. The stages ingest,
    chunking and index_vector are timed, counted and logged where `metrics` and `log` are given.
    """
    before = store.manifest()
    if mark and before.marks.get(mark[0], -1) >= mark[1]:
        return Added()
    marks = dict([mark]) if mark else None
    names = fixed(described(found).drop("content"))
    fresh = fixed(unknown(names, store.table("documents", before)))
    total, new = names.count(), fresh.count()
    if not new:
        if mark:
            store.commit(before, {}, marks)
        return Added(skipped_duplicates=total)
    chosen = described(found).join(broadcast_if_small(fresh.select("path", "sha256")), ["path", "sha256"], "left_semi")
    old_chunks, parts = store.table("chunks", before), {}
    strategy = chunking.strategy_of(old_chunks) if before.rows("chunks") else strategy or "heading_recursive"
    with stage("ingest", metrics, log) as counts:
        raw = fixed(raw_pages(chosen, parser))
        out = jobs.ingested(fresh, raw, strategy, **sizes)
        parts |= {t: store.part(t, df) for t, df in (("documents", out.documents), ("pages", out.pages))}
        counts |= {"documents.count": new, "pages.count": parts["pages"]["rows"], "duplicates.count": total - new}
    with stage("chunking", metrics, log) as counts:
        parts["chunks"] = store.part("chunks", out.chunks)
        counts |= {"chunks.count": parts["chunks"]["rows"]}
    with stage("index_vector", metrics, log) as counts:
        chunks = store.of_part("chunks", parts["chunks"])
        known = index_of(store.table("embeddings", before)) if before.rows("embeddings") else None
        if known and before.rows("embeddings") != before.rows("chunks"):
            raise ValueError("embeddings and chunks of the store differ in number")
        if known and jobs.provider_of(known[0]) != "local_hash":
            raise ValueError(f"the store's embeddings are of provider {known[0]}; its model must embed the new chunks")
        if known:
            rows, kept = jobs.index(chunks, known[1], known[2]).withColumn("row_idx", F.col("row_idx") + before.rows("embeddings")), before.parts["embeddings"]
        else:
            rows, kept = jobs.index(old_chunks.unionByName(chunks), dimensions=dimensions), []
        parts["embeddings"] = store.part("embeddings", rows)
        counts |= {"chunks.indexed": parts["embeddings"]["rows"]}
    tables = {t: [*(kept if t == "embeddings" else before.parts.get(t, [])), p] for t, p in parts.items()}
    after = store.commit(before, tables, marks)
    if any(len(p) > MOST_PARTS for p in after.parts.values()):
        store.replace(lambda m: {t: store.table(t, m) for t in m.parts})
    return Added(new, parts["pages"]["rows"], parts["chunks"]["rows"], total - new)


def additions(store: Store, folder: str, checkpoint: str, source: str = "files", suffix: str = "pdf", parser: PageParser | None = None, most_files: int = 10_000, **how) -> StreamingQuery:
    """Adds the files that come into a folder, batch by batch, until all that are there are in; then it ends.

    The stream's checkpoint knows which files were read, and the store's marks which batches were committed: a run that
    was stopped between the two commits its last batch once.
    """

    def batch(found: DataFrame, number: int) -> None:
        add(store, found, parser, mark=(source, number), **how)

    files = store.spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true")
    stream = files.option("maxFilesPerTrigger", most_files).load(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove(store: Store, doc_id: str) -> bool:
    """Takes a document out of all tables by one commit, its embeddings too, and numbers the others anew; False if the
    store hasn't got it."""
    before = store.manifest()
    if store.table("documents", before).where(F.col("doc_id") == doc_id).isEmpty():
        return False
    left = {t: store.table(t, before).where(F.col("doc_id") != doc_id) for t in ("documents", "pages", "chunks")}
    if before.rows("embeddings"):
        left["embeddings"] = realigned(store.table("embeddings", before), left["chunks"])
    store.commit(before, {t: [store.part(t, df)] for t, df in left.items()})
    return True


def received(spark: SparkSession, folder: str, uploads: list[tuple[str, object]], suffix: str = ".pdf") -> list[str]:
    """Writes uploads (name, bytes, or an object with getvalue or read) into a folder; the paths, in their order.

    Of a name the last part counts; one without it is upload_<number>, and the suffix is added where it lacks. Of two
    equal names the later one's content stays. Bytes go through the driver, as they have come to it.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    paths = []
    for k, (name, content) in enumerate(uploads, 1):
        name = name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1].strip() or f"upload_{k}{suffix}"
        name = name if name.lower().endswith(suffix) else name + suffix
        if not isinstance(content, bytes | bytearray):
            if not hasattr(content, "getvalue") and not hasattr(content, "read"):
                raise TypeError(f"upload {k} has neither bytes nor getvalue nor read")
            content = content.getvalue() if hasattr(content, "getvalue") else content.read()
            if not isinstance(content, bytes | bytearray):
                raise TypeError(f"upload {k} gives no bytes")
        path = hadoop.Path(f"{folder.rstrip('/')}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(content))
        out.close()
        paths.append(path.toString())
    return paths


def row_counts(store: Store, manifest: Manifest | None = None) -> dict[str, int]:
    """Rows of each table, from the manifest alone."""
    manifest = manifest or store.manifest()
    return {t: manifest.rows(t) for t in store.schemas}
