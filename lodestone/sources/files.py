"""Reading document files, tables of the engine, logs and configuration."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import EMPTY_PAGE, document_type, first_line, is_diagram, page_text

#: A parser of real PDF bytes: from a file's content to its pages' texts. None stands for "can't".
PageParser = Callable[[bytes], list[str] | None]


#: What Spark's reader of whole files gives.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, content, doc_id, sha256, document_type) of every file with the suffix under the folder."""
    return described(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder))


def discovered(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, length, modificationTime) of the files with the suffix under a folder, in the order of their paths. No
    folder, and no such file, is an error. Contents aren't read."""
    if not _exists(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(folder)
    found = found.select("path", "length", "modificationTime").orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no {suffix} files under {folder}")
    return found


def described(found: DataFrame) -> DataFrame:
    """(path, content) with doc_id, sha256 and document_type."""
    sha = F.sha2("content", 256)
    return found.select("path", "content", sha.alias("sha256"), F.concat(F.lit("doc_"), F.substring(sha, 1, 12)).alias("doc_id"), document_type(F.col("path")).alias("document_type"))


def page_texts(content: Column) -> Column:
    """Pages of a plain text file: parts between form feeds that aren't blank. Invalid bytes are left out."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    parts = F.filter(F.split(text, "\f"), lambda p: F.trim(p, F.lit(" \t\r\n\x0b\f")) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(EMPTY_PAGE)))


def raw_pages(found: DataFrame, parser: PageParser | None = None) -> DataFrame:
    """(doc_id, page, text, parsed): pages as they are. Files that begin with %PDF go through `parser`, if there is one; what
    it can't read, and all other files, are read as text."""
    if parser is None:
        texts = found.select("doc_id", page_texts(F.col("content")).alias("texts"), F.lit(False).alias("parsed"))
    else:

        def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for content in frame["content"]:
                    try:
                        out.append(parser(bytes(content)) if bytes(content[:4]) == b"%PDF" else None)
                    except Exception:  # whatever the parser raises, the file is read as text
                        out.append(None)
                yield frame.assign(parsed=[p or None for p in out])

        rows = found.select("doc_id", "content").mapInPandas(parsed, "doc_id string, content binary, parsed array<string>")
        texts = rows.select("doc_id", F.coalesce("parsed", page_texts(F.col("content"))).alias("texts"), F.col("parsed").isNotNull().alias("parsed"))
    return texts.select("doc_id", "parsed", F.posexplode("texts").alias("page", "text")).select("doc_id", F.col("page") + 1, "text", "parsed").toDF("doc_id", "page", "text", "parsed")


def pages(found: DataFrame, parser: PageParser | None = None) -> DataFrame:
    """(doc_id, page, text): pages with their lines stripped, less blank ones and boilerplate."""
    return raw_pages(found, parser).select("doc_id", "page", page_text(F.col("text")).alias("text"))


def documents(found: DataFrame, page_rows: DataFrame) -> DataFrame:
    """(doc_id, title, source_path, sha256, document_type, n_pages); the title is the first page's first line, or the file's
    name. n_pages counts the pages, whatever rows each has."""
    first = page_rows.where((F.col("page") == 1) & (F.col("text") != EMPTY_PAGE)).select("doc_id", F.substring(first_line(F.col("text")), 1, 200).alias("title"))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    n_pages = page_rows.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    named = found.join(first, "doc_id", "left").join(n_pages, "doc_id", "left")
    return named.select("doc_id", F.coalesce("title", name).alias("title"), F.col("path").alias("source_path"), "sha256", "document_type", F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"))


def typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table in the columns and types declared: missing columns are null, empty lists without a type are
    lists of theirs, and a table without columns has no rows."""
    found = spark.read.parquet(path)
    if not found.columns:
        return spark.createDataFrame([], schema)
    cast = lambda f: F.when(F.size(f.name) > 0, F.lit(None)).otherwise(F.array()) if f.name in found.columns and f.dataType.typeName() == "array" and found.schema[f.name].dataType != f.dataType else (F.col(f.name) if f.name in found.columns else F.lit(None))
    return found.select(*[cast(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): the lines of text files, numbered from 1 in each file.

    Files are read in splits. The lines of a split are numbered as they are read, and the numbers of lines in the splits
    before it, a row each, are added. No file is read by one task alone, and no line is shuffled unless the splits are
    too many to be broadcast.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = read.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Spark gives a task's rows rising ids, and a scan of the same files the same tasks
    offsets = splits.select("file", "block", (F.col("first") - before).alias("shift"))
    return read.join(offsets, ["file", "block"]).select("file", (F.col("id") - F.col("shift") + 1).alias("line_no"), "line")


def parsed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line, record, kind) of the lines that aren't blank: `record` is the line as a VARIANT, null if it
    isn't JSON; kind is object, other (for any other JSON) or invalid."""
    lines = numbered_lines(spark, path).where(F.length(F.trim("line", F.lit(" \t\r\x0b\f"))) > 0).withColumn("record", F.try_parse_json("line"))
    kind = F.when(F.col("record").isNull(), "invalid").when(F.schema_of_variant("record").startswith("OBJECT"), "object").otherwise("other")
    return lines.withColumn("kind", kind)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line_no, the schema's columns): the JSON objects of JSON lines files. Blank lines and JSON that is no object
    go; a line that isn't JSON is an error that names its file and number. No file is no row."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    ddl = ddl if ddl.lower().startswith("struct<") else StructType.fromDDL(ddl).simpleString()
    if not _exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL("file string, line_no long")).select("*", F.from_json(F.lit("{}"), ddl).alias("r")).select("file", "line_no", "r.*")
    broken = F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(" at line "), F.col("line_no").cast("string")))
    rows = parsed_lines(spark, path).where(F.when(F.col("kind") == "invalid", broken).otherwise(F.col("kind") == "object"))
    return rows.select("file", "line_no", F.from_json("line", ddl).alias("r")).select("file", "line_no", "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, or one that a pattern matches."""
    fs, where = file_system(spark, path)
    return bool(fs.globStatus(where))


#: Rows of an array that are decoded at a time.
NPY_ROWS = 4096


def npy_rows(found: DataFrame, element: str | None = None) -> DataFrame:
    """(path, content) of `.npy` files to (path, row_idx, embedding): the rows of each two-dimensional array.

    A file's header says its type and shape; then rows are taken from its bytes in ranges, so beside the content only one
    range is decoded at a time. The element type is the arrays' own, float or double, unless one is given; arrays of
    different types need it given. Anything but a matrix of numbers is an error. A file must fit in one row, 2 GB.
    """
    if element is None:
        kinds = [r[0] for r in found.select(F.regexp_extract(F.substring("content", 1, 512).cast("string"), r"'descr':\s*'([^']+)'", 1)).distinct().limit(3).collect()]
        if len(kinds) > 1:
            raise ValueError(f"arrays of different types: {kinds}")
        element = {"f4": "float", "f8": "double", "i4": "int", "i8": "bigint"}.get(kinds[0][1:], "double") if kinds else "double"

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                head = io.BytesIO(content[: 1 << 16])
                version = np.lib.format.read_magic(head)
                shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
                if len(shape) != 2 or kind.kind not in "fiu":
                    raise ValueError(f"{path} holds no matrix of numbers: {kind}, {shape}")
                flat = np.frombuffer(content, kind, shape[0] * shape[1], head.tell())
                matrix = flat.reshape(shape, order="F" if by_column else "C")
                for at in range(0, shape[0], NPY_ROWS):
                    part = matrix[at : at + NPY_ROWS]
                    yield pd.DataFrame({"path": path, "row_idx": np.arange(at, at + len(part)), "embedding": list(part)})

    return found.select("path", "content").mapInPandas(rows, f"path string, row_idx long, embedding array<{element}>")


#: A parser of images: from a file's content to its pages' images, each a mapping with name, x0, top, x1, bottom, width, height.
ImageParser = Callable[[bytes], list[list[dict]]]


def image_boxes(found: DataFrame, parser: ImageParser) -> DataFrame:
    """(path, content) to (path, page_num, image_idx, name, x0, y0, x1, y1, width, height, area) of every image.

    Pages and their images are numbered from 1. What is no number counts as 0, and an image without a name is called
    img_<page>_<number>. A null content, and a file without images, has no rows.
    """

    def number(value: object) -> float:
        try:
            return float(value) if isinstance(value, int | float | str) else 0.0
        except ValueError:
            return 0.0

    @F.udtf(returnType="page_num int, image_idx int, name string, x0 double, y0 double, x1 double, y1 double, width double, height double, area double")
    class Boxes:
        def eval(self, content: bytes):
            for page, images in enumerate(parser(bytes(content)) if content is not None else [], 1):
                for k, image in enumerate(images, 1):
                    at = [number(image.get(c)) for c in ("x0", "top", "x1", "bottom", "width", "height")]
                    yield page, k, str(image.get("name", f"img_{page}_{k}")), *at, at[4] * at[5]

    return found.select("path", "content").lateralJoin(Boxes(F.col("content").outer())).drop("content")


def diagrams(boxes: DataFrame, least: float = 100, most_ratio: float = 8.0) -> DataFrame:
    """Those images that are large and not too narrow to be diagrams."""
    return boxes.where(is_diagram(F.col("width"), F.col("height"), least, most_ratio))


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as declared; no rows where there is no such table."""
    return typed(spark, path, schema) if file_system(spark, path)[0].exists(file_system(spark, path)[1]) else spark.createDataFrame([], schema)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header, all columns as strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def matrix_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(run_id, the schema's columns): the rows of a result file, one JSON object with a list `rows`. What is no object
    among them goes; a file that is no object or has no such list is an error."""
    whole = spark.read.text(path, wholetext=True)
    payload = whole.select(F.from_json("value", "struct<run_id:string,rows:array<string>>").alias("x"))
    if payload.where("x IS NULL OR x.rows IS NULL").limit(1).count():
        raise ValueError(f"no result rows in {path}")
    row = payload.select("x.run_id", F.explode("x.rows").alias("raw")).where(F.col("raw").rlike(r"^\s*\{"))
    return row.select("run_id", F.from_json("raw", schema).alias("row")).select("run_id", "row.*")


def mapping(path: str) -> dict:
    """The mapping that a YAML file holds; an empty file is an empty one, anything else an error."""
    import yaml

    found = yaml.safe_load(Path(path).read_text())
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found or {}


def file_system(spark: SparkSession, path: str):
    """The file system that a path is in, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def newest_run(spark: SparkSession, root: str, holding: str = "chunks.parquet") -> str | None:
    """The run under `root` that holds the table and changed last, ties by name; None if there is none."""
    fs, top = file_system(spark, root)
    changed = [(-fs.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, n)).getModificationTime(), n) for n in run_names(spark, root, holding)]
    return min(changed)[1] if changed else None


def run_names(spark: SparkSession, root: str, holding: str = "chunks.parquet") -> list[str]:
    """Names of the folders under `root` that hold a table, sorted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory() and fs.exists(hadoop.Path(s.getPath(), holding)))


def resolved_source(spark: SparkSession, run_id: str, config: dict, root: str, holding: str = "chunks.parquet") -> str:
    """The folder that a run's chunks are taken from, by the first of these that says so.

    The configuration's source_run_id, a run under `root`; its source_artifact_dir; the first of its source_artifacts that
    has the run, or else any run, of which the last changed one; the run itself under `root`; the run there that changed
    last. The first two are taken as they are; of the others only folders that hold the table count. None is an error.
    """
    name = lambda key: config[key].strip() if isinstance(config.get(key), str) and config[key].strip() else None
    base = root.rstrip("/")
    if name("source_run_id"):
        return f"{base}/{name('source_run_id')}"
    if name("source_artifact_dir"):
        return name("source_artifact_dir")
    listed = config.get("source_artifacts")
    for top in [x.rstrip("/") for x in listed if isinstance(x, str)] if isinstance(listed, list) else []:
        if _exists(spark, f"{top}/{run_id}/{holding}"):
            return f"{top}/{run_id}"
        if newest := newest_run(spark, top, holding):
            return f"{top}/{newest}"
    if _exists(spark, f"{base}/{run_id}/{holding}"):
        return f"{base}/{run_id}"
    if newest := newest_run(spark, base, holding):
        return f"{base}/{newest}"
    raise FileNotFoundError(f"no run under {root} holds {holding}: set source_run_id or source_artifact_dir")


def resolved_questions(spark: SparkSession, run_id: str, config: dict, root: str, given: str | None = None) -> str:
    """The file of a run's questions: the one given, the configuration's dataset_path or questions_path, or the last by
    name of the run's questions_*.jsonl. None is an error."""
    for value in (given, config.get("dataset_path"), config.get("questions_path")):
        if isinstance(value, str) and value.strip():
            return value.strip()
    fs, where = file_system(spark, f"{root.rstrip('/')}/{run_id}/questions_*.jsonl")
    found = sorted(s.getPath().toString() for s in fs.globStatus(where) or [])
    if not found:
        raise FileNotFoundError(f"no questions for {run_id}: set dataset_path or generate some")
    return found[-1]


TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def _within(least: float | None = None, most: float | None = None, above: float | None = None, one_of: tuple = (), default: object = None):
    return field(default=default, metadata={"least": least, "most": most, "above": above, "one_of": one_of})


@dataclass(frozen=True)
class Settings:
    """What a run can be set to; each value from a file, an environment variable LODESTONE_<NAME>, or the caller."""

    artifact_root: str = "artifacts"
    log_level: str = "INFO"
    chunk_strategy: str = "heading_recursive"
    chunk_size: int = _within(20, default=512)
    chunk_overlap: int = _within(0, default=50)
    sentence_window: int = _within(1, default=5)
    breakpoint: float = _within(0, 1, default=0.2)
    embedding_provider: str = _within(one_of=("local", "local_hash", "ollama"), default="local")
    embedding_model: str = _within(one_of=("+",), default="hash")
    embedding_dim: int = _within(8, default=256)
    model_url: str = _within(one_of=("+",), default="http://localhost:11434")
    model_timeout: float = _within(above=0, default=30.0)
    model_key: str = ""
    top_k: int = _within(1, default=8)
    reranker_enabled: bool = False
    reranker_model: str = _within(one_of=("+",), default="llama3:8b")
    rerank_candidates: int = _within(1, default=30)
    answer_local: bool = False
    answer_model: str = _within(one_of=("+",), default="llama3")
    answer_temperature: float = _within(0, 2, default=0.2)
    answer_tokens: int = _within(1, default=512)
    answer_sentences: int = _within(1, default=6)
    graph_depth: int = _within(1, default=2)
    vector_weight: float = _within(0, default=0.6)
    graph_weight: float = _within(0, default=0.4)
    support_lexical: float = _within(0, default=0.7)
    support_hit: float = _within(0, default=0.3)
    support_floor: float = _within(0, default=0.001)


def _typed(f, value: object) -> object:
    """A setting's value in its type and range; anything else is an error that names the setting."""
    kind = type(f.default)
    wrong = ValueError(f"{f.name}: {value!r} is no {kind.__name__} that it can be")
    if kind is bool:
        word = str(value).strip().lower()
        if word not in TRUE + FALSE:
            raise wrong
        return word in TRUE
    if isinstance(value, bool) or (kind is int and isinstance(value, float) and value != int(value)):
        raise wrong
    try:
        out = kind(value.strip() if isinstance(value, str) and kind is not str else value)
    except (TypeError, ValueError):
        raise wrong from None
    m = f.metadata
    outside = [(m.get("least"), lambda x: out < x), (m.get("most"), lambda x: out > x), (m.get("above"), lambda x: out <= x)]
    if any(x is not None and bad(x) for x, bad in outside):
        raise wrong
    if m.get("one_of") and (not out.strip() if m["one_of"] == ("+",) else out not in m["one_of"]):
        raise wrong
    return out


def settings(path: str | None = None, **given) -> Settings:
    """Defaults, then the YAML file, then the environment, then what is given.

    A file that isn't there, or holds no mapping, says nothing; nor does an environment variable that is empty, or a
    given None. A name that is no setting, and a value that isn't of its setting's kind or range, is an error.
    """
    layers: list[dict] = []
    if path and Path(path).exists():
        import yaml

        loaded = yaml.safe_load(Path(path).read_text())
        layers.append(loaded if isinstance(loaded, dict) else {})
    layers += [{f.name: v for f in fields(Settings) if (v := os.environ.get(f"LODESTONE_{f.name.upper()}"))}, given]
    merged = {k: v for layer in layers for k, v in layer.items() if v is not None}
    if unknown := set(merged) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **{f.name: _typed(f, merged[f.name]) for f in fields(Settings) if f.name in merged})
