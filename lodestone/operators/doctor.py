"""Checks of what a run needs and has left: which of the files wanted are there, and whether they hold what they should.

Whether a path exists is asked of its file system, once for each of the few that are wanted. Contents are checked by
Spark, all files of a kind in one aggregate, however long they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_system, parsed_lines

CHECKS = "name string, status string, path string, message string, hint string"
KINDS = ("directory", "pdfs", "file", "text", "answers", "payloads", "csv", "matrix")


@dataclass(frozen=True)
class Wanted:
    """A path to be checked, what it should be (one of KINDS), and what to do if it isn't that.

    A file may also be a folder of part files, as Spark writes it.
    """

    name: str
    path: str
    kind: str
    hint: str = ""


def _said(record: Column, *path: str) -> Column:
    """Whether a VARIANT has a text that isn't blank at a path."""
    found = F.try_variant_get(record, "$." + ".".join(path), "variant")
    text = F.try_variant_get(record, "$." + ".".join(path), "string")
    return F.coalesce((F.schema_of_variant(found) == "STRING") & text.rlike(r"(?U)\S"), F.lit(False))


def _lacks(kind: str, record: Column) -> Column:
    """The first field of a row that isn't as it should be; null if all are."""
    if kind == "answers":
        cited = F.coalesce(F.size(F.try_variant_get(record, "$.citations", "array<variant>")) > 0, F.lit(False))
        return F.when(~_said(record, "answer_text"), "non-empty `answer_text`").when(~cited, "non-empty `citations`")
    is_object = F.coalesce(F.schema_of_variant(F.try_variant_get(record, "$.answer_record", "variant")).startswith("OBJECT"), F.lit(False))
    out = F.when(~_said(record, "question"), "non-empty `question`").when(~is_object, "object `answer_record`")
    return out.when(~_said(record, "answer_record", "answer_text"), "non-empty `answer_record.answer_text`")


def line_problems(lines: DataFrame, kind: str) -> DataFrame:
    """(file, line_no, record, kind) of parsed lines to (file, n_rows, problem): null where all rows are as they should be.

    A line that isn't JSON, or is no object, comes before what other rows lack. Rows are numbered without blank lines.
    """
    at = F.col("line_no").cast("string")
    broken = F.when(F.col("kind") == "invalid", F.concat(F.lit("Invalid JSON on line "), at, F.lit("."))).when(F.col("kind") == "other", F.concat(F.lit("Row "), at, F.lit(" is not a JSON object.")))
    rows = lines.select("file", "line_no", broken.alias("broken"), F.when(F.col("kind") == "object", _lacks(kind, F.col("record"))).alias("lacks"))
    first = rows.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("line_no"))).alias("broken"),
        F.min_by("lacks", F.when(F.col("lacks").isNotNull(), F.col("line_no"))).alias("lacks"), F.min(F.when(F.col("lacks").isNotNull(), F.col("line_no"))).alias("at"),
    )
    before = rows.join(first.select("file", "at"), "file").groupBy("file").agg(F.count_if(F.col("line_no") <= F.col("at")).cast("string").alias("row"))
    found = F.coalesce("broken", F.when(F.col("lacks").isNotNull(), F.concat(F.lit("Row "), "row", F.lit(" is missing "), "lacks", F.lit("."))))
    return first.join(before, "file").select("file", "n_rows", found.alias("problem"))


def _keyed(df: DataFrame, files: dict[str, str]) -> DataFrame:
    """Adds the path wanted that a file is, or is a part of, in the column file."""
    file = F.regexp_replace("file", "^file:/+", "file:/")
    parent = F.regexp_replace(file, "/[^/]*$", "")
    return df.withColumn("file", F.when(file.isin(list(files)), file).otherwise(parent))


def _lines(spark: SparkSession, kind: str, files: dict[str, str]) -> dict[str, tuple[str, str]]:
    found = {r["file"]: r for r in line_problems(_keyed(parsed_lines(spark, list(files.values())), files), kind).collect()}  # one row a file
    unit = "answer row(s) with required fields" if kind == "answers" else "demo payload sample row(s)"
    out = {}
    for f in files:
        r = found.get(f)
        out[f] = ("invalid", "File is empty.") if r is None else ("invalid", r["problem"]) if r["problem"] else ("valid", f"Validated {r['n_rows']} {unit}.")
    return out


def _texts(spark: SparkSession, kind: str, files: dict[str, str]) -> dict[str, tuple[str, str]]:
    whole = spark.read.text(list(files.values())).select(F.col("_metadata.file_path").alias("file"), "value")
    some = {r[0] for r in _keyed(whole.where(F.col("value").rlike(r"(?U)\S")), files).select("file").distinct().collect()}
    name = lambda f: files[f].rstrip("/").rsplit("/", 1)[-1]
    return {f: ("valid", f"Validated non-empty text file: {name(f)}.") if f in some else ("invalid", f"File is empty: {name(f)}.") for f in files}


def _tables(spark: SparkSession, kind: str, files: dict[str, str]) -> dict[str, tuple[str, str]]:
    out = {}
    for f, path in files.items():  # a file each, as their columns differ
        rows = spark.read.csv(path, header=False, multiLine=True, escape='"')
        header = rows.first()
        if header is None or any(not (x or "").strip() for x in header):
            out[f] = ("invalid", "CSV header is missing or empty.")
            continue
        filled = F.exists(F.array(*map(F.col, rows.columns)), lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False)))
        n = rows.where(filled).count() - 1
        out[f] = ("valid", f"Validated matrix CSV with {n} row(s).") if n > 0 else ("invalid", "CSV has no data rows.")
    return out


def _matrices(spark: SparkSession, kind: str, files: dict[str, str]) -> dict[str, tuple[str, str]]:
    whole = spark.read.text(list(files.values()), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("v"))
    of = lambda key: F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, ("run_id", "summary", "rows"))), keys)
    rows = F.try_variant_get("v", "$.rows", "array<variant>")
    problem = (
        F.when(~F.col("value").rlike(r"(?U)\S"), "JSON file is empty.").when(F.col("v").isNull(), "Invalid JSON object.")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "Expected top-level JSON object.")
        .when(F.size(lacking) > 0, F.concat(F.lit("Missing top-level key(s): "), F.array_join(lacking, ", "), F.lit(".")))
        .when(~of("summary").startswith("OBJECT"), "Top-level `summary` must be a JSON object.").when(~of("rows").startswith("ARRAY"), "Top-level `rows` must be a JSON array.")
        .when(F.size(rows) == 0, "Top-level `rows` array is empty.")
        .when(~F.forall(rows, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), "Top-level `rows` contains non-object entries.")
    )
    found = {r["file"]: r for r in _keyed(whole, files).select("file", problem.alias("problem"), F.size(rows).alias("n")).collect()}
    return {f: ("invalid", "JSON file is empty.") if f not in found else ("invalid", found[f]["problem"]) if found[f]["problem"] else ("valid", f"Validated matrix JSON with {found[f]['n']} row(s).") for f in files}


_CONTENTS = {"text": _texts, "answers": _lines, "payloads": _lines, "csv": _tables, "matrix": _matrices}


def checked(spark: SparkSession, wanted: list[Wanted]) -> DataFrame:
    """(name, status, path, message, hint), a row for each path wanted: valid, missing or invalid."""
    out: dict[Wanted, tuple[str, str]] = {}
    contents: dict[str, dict[str, list[Wanted]]] = {}
    for w in wanted:
        if w.kind not in KINDS:
            raise ValueError(f"unknown kind of check: {w.kind}")
        fs, path = file_system(spark, w.path)
        status = fs.getFileStatus(path) if fs.exists(path) else None
        name = path.getName()
        if w.kind in ("directory", "pdfs"):
            if status is None:
                out[w] = ("missing", "Missing required directory.")
            elif not status.isDirectory():
                out[w] = ("invalid", "Path exists but is not a directory.")
            elif w.kind == "directory":
                out[w] = ("valid", "Found required directory.")
            else:
                n = sum(s.isFile() and s.getPath().getName().lower().endswith(".pdf") for s in fs.listStatus(path))
                out[w] = ("valid", f"Found {n} PDF file(s) for demo ingestion.") if n else ("invalid", "No PDF files found in demo input directory.")
        elif status is None:
            out[w] = ("missing", f"Missing required file: {name}.")
        elif status.isDirectory() and not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(path)):
            out[w] = ("invalid", f"Path exists but is not a file: {name}.")
        elif w.kind == "file":
            out[w] = ("valid", f"Found required file: {name}.")
        else:
            contents.setdefault(w.kind, {}).setdefault(re.sub("^file:/+", "file:/", fs.makeQualified(path).toUri().toString()), []).append(w)
    for kind, files in contents.items():
        for f, said in _CONTENTS[kind](spark, kind, {f: ws[0].path for f, ws in files.items()}).items():
            out |= {w: said for w in files[f]}
    rows = [(w.name, out[w][0], w.path, out[w][1], w.hint if out[w][0] != "valid" else None) for w in wanted]
    return spark.createDataFrame(rows, CHECKS)


def report(checks: DataFrame, run_id: str) -> DataFrame:
    """One row: the run's status, ok if all checks are valid, and how many are valid, invalid, missing and present."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "missing")]
    out = checks.agg(*counts)
    status = F.when((F.col("invalid") == 0) & (F.col("missing") == 0), "ok").otherwise("error")
    return out.select(F.lit(run_id).alias("run_id"), status.alias("status"), "valid", "invalid", "missing", F.col("valid").alias("present"))
