"""Counters, timers and structured logs of runs, kept as rows that Spark reads back.

Counts of a job are taken while its rows pass (`DataFrame.observe`), so counting costs no second pass. Each stage writes
one file of its own at its end, also when it ends with an error; writers share no file and need no lock.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "run_id string, stage string, metric_name string, value double, timestamp string"
LOG = ("timestamp", "level", "run_id", "stage", "event")


def appended(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """A new file of JSON lines in a folder that all can reach: for the few rows of a driver."""
    if rows:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        name = hadoop.Path(f"{path.rstrip('/')}/part-{time.time_ns():020d}-{uuid.uuid4().hex}.json")
        out = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name, False)
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
        out.close()


def now() -> str:
    return datetime.now(UTC).isoformat()


class Stage:
    """What is counted within one stage."""

    def __init__(self):
        self.counters: list[tuple[str, float]] = []
        self.observed: list[tuple[Observation, DataFrame]] = []

    def counter(self, metric_name: str, value: float = 1.0) -> None:
        self.counters.append((metric_name, float(value)))

    def observe(self, df: DataFrame, **counts: Column) -> DataFrame:
        """The same rows; when they are first computed within the stage, each aggregate becomes a counter <name>.count."""
        seen = Observation(uuid.uuid4().hex)
        out = df.observe(seen, *[c.alias(f"{n}.count") for n, c in counts.items()])
        self.observed.append((seen, out))
        return out

    def counts(self) -> list[tuple[str, float]]:
        """Counters, and observations of rows that were computed; those of rows that never were don't count."""
        done = []
        for seen, _ in self.observed:
            row = seen._jo.getRowOrEmpty()  # `get` would wait for a job that failed
            if row.isDefined():
                seen_row = row.get()
                done += [(n, float(v)) for n in seen_row.schema().fieldNames() if (v := seen_row.getAs(n)) is not None]  # null: no row came
        return self.counters + done


class Metrics:
    """Writes (run_id, stage, metric_name, value, timestamp) rows of a run."""

    def __init__(self, spark: SparkSession, run_id: str, path: str):
        self.spark, self.run_id, self.path = spark, run_id, path

    def _write(self, stage: str, values: list[tuple[str, float]]) -> None:
        appended(self.spark, self.path, [{"run_id": self.run_id, "stage": stage, "metric_name": n, "value": v, "timestamp": now()} for n, v in values])

    def counter(self, stage: str, metric_name: str, value: float = 1.0) -> None:
        self._write(stage, [(metric_name, float(value))])

    @contextmanager
    def timer(self, stage: str, metric_name: str | None = None) -> Iterator[Stage]:
        """Times what is done inside and writes its seconds and counts, after an error too."""
        inside, began = Stage(), time.perf_counter()
        try:
            yield inside
        finally:
            seconds = time.perf_counter() - began
            self._write(stage, [*inside.counts(), (metric_name or f"{stage}.seconds", seconds)])


class StreamMetrics(StreamingQueryListener):
    """Writes the observed counts and seconds of every batch of a session's streams; to be added to `spark.streams`."""

    def __init__(self, metrics: Metrics, stage: str):
        self.metrics, self.stage = metrics, stage

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = [(n, float(v)) for row in p.observedMetrics.values() for n, v in row.asDict().items() if v is not None]
        self.metrics._write(self.stage, [*seen, ("rows.count", float(p.numInputRows)), ("batch.seconds", p.batchDuration / 1000)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.metrics.counter(self.stage, "failed.count")


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def rolled_up(metrics: DataFrame) -> DataFrame:
    """(run_id, stage, metric_name, n, total, mean, most) of metric rows."""
    value = F.col("value")
    return metrics.groupBy("run_id", "stage", "metric_name").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))


class Log:
    """Writes events of a run as JSON rows with whatever fields each has."""

    def __init__(self, spark: SparkSession, run_id: str, path: str):
        self.spark, self.run_id, self.path = spark, run_id, path

    def _emit(self, level: str, stage: str, event: str, fields: dict) -> None:
        appended(self.spark, self.path, [{"timestamp": now(), "level": level, "run_id": self.run_id, "stage": stage, "event": event, **fields}])

    def info(self, stage: str, event: str, **fields) -> None:
        self._emit("info", stage, event, fields)

    def error(self, stage: str, event: str, **fields) -> None:
        self._emit("error", stage, event, fields)


def logged(rows: DataFrame, path: str, fields: str | None = None) -> None:
    """Appends rows (the columns of LOG) as JSON lines; `fields` names a column with the text of a JSON object whose
    members become members of the row. A field with the name of one of LOG's columns stands in its place; a text that is
    no object adds nothing."""
    given = F.col(fields) if fields else F.lit(None).cast("string")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(given)).startswith("OBJECT"), F.lit(False))
    more = F.when(is_object, F.trim(F.regexp_extract(given, r"(?s)^\s*\{(.*)\}\s*$", 1))).otherwise("")
    taken = F.coalesce(F.when(is_object, F.json_object_keys(given)), F.array().cast("array<string>"))
    own = F.to_json(F.struct(*[F.when(~F.array_contains(taken, c), F.col(c).cast("string")).alias(c) for c in LOG]))
    inner = F.substring(own, F.lit(2), F.length(own) - 2)
    rows.select(F.concat(F.lit("{"), F.array_join(F.filter(F.array(inner, more), lambda x: x != ""), ","), F.lit("}")).alias("value")).write.mode("append").text(path)


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, level, run_id, stage, event, record): `record` is the whole row as a VARIANT, from which any field of
    any row can be taken, whatever the others have: variant_get(record, '$.name', 'type')."""
    read = spark.read.format("json").option("singleVariantColumn", "record").load(path)
    return read.select(*[F.try_variant_get("record", f"$.{c}", "string").alias(c) for c in LOG], "record")
