"""Writing tables, logs and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns of a matrix result file.
MATRIX_COLUMNS = "run_id exp_id chunking embedding embedding_provider embedding_model retrieval reranker_enabled reranker_model recall_at_5 recall_at_10 ndcg_at_5 ndcg_at_10 citation_precision faithfulness_proxy latency_ms".split()


def overwritten(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def logged(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; every call adds files of its own, so writers need no lock."""
    df.write.mode("append").json(path)


def replaced(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there, so that readers of `path` never see half of it and `df` may
    read what it replaces."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, staged, old = (hadoop.Path(f"{path.rstrip('/')}{x}") for x in ("", f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    df.write.parquet(staged.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(staged, target):
        raise OSError(f"can't move the new table to {path}")
    fs.delete(old, True)


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    df.write.mode("overwrite").json(path)


def matrix_files(rows: DataFrame, path: str) -> None:
    """An experiment matrix's results as CSV with the usual columns, as JSON with a summary that names the best
    experiment, and as JSON lines by experiment. Columns that `rows` lacks are null. The matrix is a bounded grid."""
    out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in MATRIX_COLUMNS])
    out.coalesce(1).write.mode("overwrite").csv(f"{path}/matrix.csv", header=True)
    best = F.min_by("exp_id", F.struct(-F.coalesce("ndcg_at_10", F.lit(0.0)).cast("double"), F.col("exp_id")))
    one = F.struct(*MATRIX_COLUMNS)
    out.agg(F.min("run_id").alias("run_id"), F.struct(F.count("*").alias("experiments"), best.alias("best_exp_id")).alias("summary"), F.sort_array(F.collect_list(one)).alias("rows")).coalesce(1).write.mode("overwrite").json(f"{path}/matrix.json")
    rows.write.mode("overwrite").partitionBy("exp_id").json(f"{path}/experiments")


def store_created(spark: SparkSession, root: str, name: str, tables: dict[str, StructType]) -> str:
    """A new store's folder with an empty table for each schema. A bad name, or one that is taken, is an error."""
    import re

    from ..functions.text import STORE_NAME

    name = name.strip()
    if not re.fullmatch(STORE_NAME, name):
        raise ValueError(f"bad store name: {name!r}")
    path = f"{root.rstrip('/')}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(path)
    for table, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{table}.parquet")
    return path


def store_deleted(spark: SparkSession, root: str, name: str) -> bool:
    """Deletes a store; False if there is none of the name, which must be a store's."""
    import re

    from ..functions.text import STORE_NAME

    if not re.fullmatch(STORE_NAME, name.strip()):
        raise ValueError(f"bad store name: {name!r}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name.strip()}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.delete(where, True)


def report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a small frame: a report of at most `most` rows."""
    names = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in names]), F.lit(" |"))
    body = [r[0] for r in rows.select(line).limit(most).collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body])


def runs_removed(spark: SparkSession, root: str, keep_latest: int = 3, keep: list[str] | None = None, dry_run: bool = True) -> DataFrame:
    """(run_id, state, path, message) of the folders under `root` and of the runs to be kept.

    state: retained for the latest by time of change, ties by name, and those named in `keep`; missing for a name that
    no folder has; and for the others candidate, which a dry run leaves at that, deleted, or failed with why. No folder
    at `root` is no run; a `root` that is no folder is an error.
    """
    from ..operators.store import kept_sets
    from .files import file_system

    if keep_latest < 0:
        raise ValueError("keep_latest must not be negative")
    fs, top = file_system(spark, root)
    if fs.exists(top) and not fs.getFileStatus(top).isDirectory():
        raise NotADirectoryError(root)
    found = {s.getPath().getName(): s for s in (fs.listStatus(top) if fs.exists(top) else []) if s.isDirectory()}
    runs = spark.createDataFrame([(n, s.getModificationTime()) for n, s in found.items()], "run_id string, mtime long")
    states = kept_sets(runs, spark.createDataFrame([(n,) for n in keep or []], "run_id string"), keep_latest).collect()  # a row a folder
    out = []
    for run_id, state in states:
        path, message = (found[run_id].getPath() if run_id in found else None), None
        if state == "removable":
            state = "candidate"
            if not dry_run:
                try:
                    state = "deleted" if fs.delete(path, True) else "failed"
                    message = None if state == "deleted" else "it could not be deleted"
                except Exception as error:  # one that can't be deleted doesn't keep the others
                    state, message = "failed", str(error)[:500]
        out.append((run_id, state, path.toString() if path else None, message))
    return spark.createDataFrame(out, "run_id string, state string, path string, message string")


def written_text(spark: SparkSession, path: str, text: str) -> None:
    """A file with a text, in place of what was there."""
    from .files import file_system

    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def leaderboard_report(rows: DataFrame, run_id: str) -> str:
    """A Markdown leaderboard of a matrix's results: by nDCG and recall at 10, the best first, then by latency. Missing
    numbers count as 0; no row is an error. The matrix is a bounded grid."""
    numbers = {"nDCG@10": "ndcg_at_10", "Recall@10": "recall_at_10", "Citation Precision": "citation_precision", "Faithfulness": "faithfulness_proxy", "Latency (ms)": "latency_ms"}
    value = {c: F.coalesce(F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double"), F.lit(0.0)) for c in numbers.values()}
    order = [F.desc("ndcg_at_10"), F.desc("recall_at_10"), "latency_ms", "exp_id"]
    ranked = rows.select("exp_id", *[x.alias(c) for c, x in value.items()]).orderBy(*order).collect()
    if not ranked:
        raise ValueError("no results to report")
    body = [f"| {k} | {r['exp_id']} | " + " | ".join(f"{r[c]:.2f}" if c == "latency_ms" else f"{r[c]:.4f}" for c in numbers.values()) + " |" for k, r in enumerate(ranked, 1)]
    head = ["# Experiment leaderboard", "", f"Run: `{run_id}`", "Primary metric: `nDCG@10`", ""]
    return "\n".join([*head, "| Rank | Experiment | " + " | ".join(numbers) + " |", "|---:|---|" + "---:|" * len(numbers), *body, ""])


def ab_report(result: DataFrame, metric: str) -> str:
    """A Markdown summary of one comparison of `evaluate.compared`; significant below 0.05."""
    r = result.first()
    a, b, p = r["variant_a"], r["variant_b"], r["p_value"]
    lines = [f"# A/B test: {a} and {b}", "", f"| Metric | {a} | {b} |", "|---|---:|---:|", f"| Mean {metric} | {r['mean_a']:.4f} | {r['mean_b']:.4f} |", f"| Deviation | {r['std_a']:.4f} | {r['std_b']:.4f} |", ""]
    lines += [f"- p-value: {'N/A' if p is None else f'{p:.4f}'}", f"- Significant (p < 0.05): {'yes' if p is not None and p < 0.05 else 'no'}", f"- Winner: {r['winner'] or 'tie'}"]
    if r["winner"]:
        share = abs(r["mean_a"] - r["mean_b"]) / max(r["mean_a"], r["mean_b"], 1e-8) * 100
        lines.append(f"- The winner's {metric} is {share:.1f}% better.")
    return "\n".join([*lines, ""])


def demo_report(run_id: str, config: dict, metrics: dict[str, float], answer: str) -> str:
    """A Markdown report of a demonstration: its settings and key metrics as JSON, then the answer."""
    import json

    keys = ("ndcg_at_10", "recall_at_10", "citation_precision", "faithfulness_proxy")
    payload = {"run_id": run_id, "config": config, "key_metrics": {k: float(metrics.get(k) or 0.0) for k in keys}}
    return "\n".join(["# Demonstration", "", "```json", json.dumps(payload, indent=2), "```", "", "## Answer", "", answer, ""])
