"""A store's tables, changed together or not at all.

A store is a folder of Parquet parts and numbered manifests. A manifest says of each table which parts it has and how
many rows each part holds; the one with the highest number is the store as it is. A change writes new parts first and
then moves the next manifest to its number, which fails if another change has taken it. So a reader sees all of a change
or nothing of it, what a failed change has written is named nowhere, and adding rows rewrites none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a store of documents holds.
TABLES = {
    "documents": "doc_id string, title string, source_path string, sha256 string, document_type string, n_pages long",
    "pages": "doc_id string, page int, section string, text string",
    "chunks": "chunk_id string, doc_id string, page int, section string, chunk_text string, chunk_type string, section_path string, cross_refs array<string>",
    "embeddings": "row_idx long, chunk_id string, embedding array<double>, provider string, embedding_model string, dim int",
}


class Changed(Exception):
    """Another change was made since the store was read."""


@dataclass(frozen=True)
class Manifest:
    """version 0 is a store without anything. `marks` say how far each source of additions has been taken."""

    version: int = 0
    parts: dict[str, list[dict]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def rows(self, table: str) -> int:
        return sum(p["rows"] for p in self.parts.get(table, []))


class Store:
    """The tables in a folder that all tasks can reach: each name with its columns, as in TABLES."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] = TABLES):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {name: StructType.fromDDL(ddl) for name, ddl in tables.items()}
        jvm = spark.sparkContext._jvm
        self._at = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *x]))
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs, self._jvm = self._at().getFileSystem(self._conf), jvm

    def _versions(self) -> list[int]:
        top = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """As it is now, or was at a version."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return Manifest()
        stream = self._fs.open(self._at("manifests", f"{version:09d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        parts = (manifest or self.manifest()).parts.get(name, [])
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['path']}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def part(self, name: str, rows: DataFrame) -> dict:
        """Writes rows as a part that no manifest names yet, in the table's columns and types. Rows are counted as they are
        written; a column that the rows lack is null."""
        schema = self.schemas[name]
        typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        path = f"{name}/{uuid.uuid4().hex}.parquet"
        typed.write.parquet(f"{self.path}/{path}")
        written = self.spark.read.schema(schema).parquet(f"{self.path}/{path}")
        return {"path": path, "rows": written.count()}  # from the files' footers

    def of_part(self, name: str, part: dict) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{part['path']}")

    def commit(self, before: Manifest, parts: dict[str, list[dict]], marks: dict[str, int] | None = None) -> Manifest:
        """Makes `parts` those of the tables named, all at once; other tables stay. `before` is what they were made from."""
        after = Manifest(before.version + 1, {**before.parts, **parts}, {**before.marks, **(marks or {})})
        staged, target = self._at("manifests", f"_{uuid.uuid4().hex}"), self._at("manifests", f"{after.version:09d}.json")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(staged, target, none)  # unlike FileSystem.rename it never overwrites
        except Exception as error:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(error):
                raise Changed(f"{self.path}: version {after.version} is taken") from error
            raise
        return after

    def append(self, rows: dict[str, DataFrame], marks: dict[str, int] | None = None) -> Manifest:
        before = self.manifest()
        return self.commit(before, {t: [*before.parts.get(t, []), self.part(t, df)] for t, df in rows.items()}, marks)

    def replace(self, change: Callable[[Manifest], dict[str, DataFrame]], marks: dict[str, int] | None = None) -> Manifest:
        """Tables as `change` makes them of the store as it is, each in one part."""
        before = self.manifest()
        return self.commit(before, {t: [self.part(t, df)] for t, df in change(before).items()}, marks)

    def vacuumed(self, versions: int = 1) -> int:
        """Deletes the parts that none of the last versions names, and older manifests; how many parts went. Not to be run
        beside a change, whose parts aren't named yet."""
        known = self._versions()
        named = {p["path"] for v in known[-versions:] for parts in self.manifest(v).parts.values() for p in parts}
        gone = 0
        for table in self.schemas:
            for s in self._fs.listStatus(self._at(table)) if self._fs.exists(self._at(table)) else []:
                if f"{table}/{s.getPath().getName()}" not in named:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for v in known[:-versions]:
            self._fs.delete(self._at("manifests", f"{v:09d}.json"), False)
        return gone


def readable(store: Store, table: str) -> bool:
    """Whether all of a table's rows can be read: a part that is gone or broken is found out."""
    try:
        return store.table(table).agg(F.count(F.struct("*"))).first()[0] == store.manifest().rows(table)
    except PySparkException:
        return False
