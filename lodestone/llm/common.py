"""What the training-data operators share: words, table reading, and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one gets one of our own; on a
    cluster that is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/lodestone-shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Has Spark remove a query's shuffle files when it is over.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of the steps that are under way, the innermost last.
_under_way: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    if _under_way:
        _under_way[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}


def discarded(df: DataFrame) -> None:
    """Delete a table that `written` made and that no later step reads."""
    for paths in _under_way:
        for path in [p for p in paths if p.rsplit("/", 1)[-1] in _folders(df)]:
            _deleted(df.sparkSession, path)
            paths.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are `written` inside are deleted at its end, but those that the frames given to what it yields read."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    _under_way.append([])
    try:
        yield keep
    finally:
        paths = _under_way.pop()
        for path in paths:
            if path.rsplit("/", 1)[-1] not in kept:
                _deleted(spark, path)
            elif _under_way:
                _under_way[-1].append(path)


def ready_for_python(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs in tasks: bound what one Arrow batch holds, since single texts may be very long, and let
    workers that start in another folder find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, and only where the result is asked for."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced_words(text: Column) -> Column:
    """The words of a text joined by single spaces; null for a null text."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def n_spaced(spaced: Column) -> Column:
    """Number of words of `spaced_words`, 0 for null."""
    count = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1)
    return F.coalesce(count, F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return bound(spaced_words(text), n_spaced)
