import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lodestone.functions.statistics import incomplete_beta, log_gamma, t_test_p_value
from lodestone.operators import evaluate, observability


def test_counts_and_seconds_of_a_stage(spark, tmp_path):
    metrics = observability.Metrics(spark, "run", str(tmp_path / "m"))
    df = spark.range(1000)
    with metrics.timer("ingest") as stage:
        stage.counter("files.count", 3)
        seen = stage.observe(df, rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
        never = stage.observe(df, unread=F.count("*"))
        seen.write.format("noop").mode("overwrite").save()
    with pytest.raises(ZeroDivisionError), metrics.timer("broken", "broken.took") as stage:
        stage.counter("before.count")
        raise ZeroDivisionError
    metrics.counter("ingest", "files.count")
    got = sorted((r["stage"], r["metric_name"], r["n"], r["total"]) for r in observability.rolled_up(observability.metric_rows(spark, metrics.path)).collect())
    assert [g[:3] for g in got] == [("broken", "before.count", 1), ("broken", "broken.took", 1), ("ingest", "even.count", 1), ("ingest", "files.count", 2), ("ingest", "ingest.seconds", 1), ("ingest", "rows.count", 1)]
    totals = {g[1]: g[3] for g in got}
    assert totals["rows.count"] == 1000 and totals["even.count"] == 500 and totals["files.count"] == 4 and 0 < totals["ingest.seconds"] < 60
    assert never.count() == 1000


def test_counts_of_a_failed_job_do_not_block(spark, tmp_path):
    metrics = observability.Metrics(spark, "run", str(tmp_path / "m"))
    with pytest.raises(Exception, match="stop here"), metrics.timer("ingest") as stage:
        rows = spark.range(10).withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")))
        stage.observe(rows, rows=F.sum("id")).collect()
    assert [r["metric_name"] for r in observability.metric_rows(spark, metrics.path).collect()][-1] == "ingest.seconds"


def test_counts_of_a_stream(spark, tmp_path):
    metrics = observability.Metrics(spark, "run", str(tmp_path / "m"))
    spark.range(50).write.parquet(str(tmp_path / "in"))
    listener = observability.StreamMetrics(metrics, "stream")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count("*").alias("seen.count"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    got = {r["metric_name"]: r["total"] for r in observability.rolled_up(observability.metric_rows(spark, metrics.path)).collect()}
    assert got["seen.count"] == 50 and got["rows.count"] == 50 and got["batch.seconds"] > 0


def test_log_of_unlike_fields(spark, tmp_path):
    log = observability.Log(spark, "run", str(tmp_path / "l"))
    log.info("ingest", "start", files=3, nested={"a": [1, 2]})
    log.error("ingest", "failed", reason="no \"such\" file\n", level="fatal")
    rows = spark.createDataFrame([("t1", "info", "run", "x", "e", '{"k": {"deep": 7}, "s": "a}b"}'), ("t2", "info", "run", "x", "e", "[1]"), ("t3", "info", "run", "x", "e", None), ("t4", "info", "run", "x", "e", "{}"), ("t5", "info", "run", "x", "e", ' {"stage": "other"}\n')], "timestamp string, level string, run_id string, stage string, event string, f string")
    observability.logged(rows, log.path, "f")
    observability.logged(rows.where("timestamp = 't1'"), log.path)
    out = observability.log_rows(spark, log.path).selectExpr("timestamp", "level", "stage", "event", "variant_get(record, '$.files', 'int') files", "try_variant_get(record, '$.nested.a[1]', 'int') a", "try_variant_get(record, '$.k.deep', 'int') deep", "try_variant_get(record, '$.s', 'string') s", "try_variant_get(record, '$.reason', 'string') reason")
    got = sorted(map(tuple, out.drop("timestamp").collect()), key=repr)
    assert ("info", "ingest", "start", 3, 2, None, None, None) in got and ("fatal", "ingest", "failed", None, None, None, None, 'no "such" file\n') in got
    assert got.count(("info", "x", "e", None, None, 7, "a}b", None)) == 1 and got.count(("info", "x", "e", None, None, None, None, None)) == 4 and ("info", "other", "e", None, None, None, None, None) in got


def test_distributions(spark):
    t = [0.0, 1e-9, 0.3, 1.0, 2.5, 12.0, 60.0]
    p = lambda df: [r[0] for r in spark.createDataFrame([(float(x), float(df)) for x in t], "t double, df double").select(t_test_p_value(F.col("t"), F.col("df"))).collect()]
    assert p(1) == pytest.approx([1 - 2 / math.pi * math.atan(x) for x in t], abs=1e-9)
    assert p(2) == pytest.approx([1 - x / math.sqrt(2 + x * x) for x in t], abs=1e-9)
    for df in (3.7, 10, 118.25, 5000.5, 2e6):
        u = np.linspace(0, 1, 400_001)
        for x, got in zip(t, p(df), strict=True):  # Simpson's rule over the density
            y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p((u * x) ** 2 / df))
            area = x / 400_000 / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
            assert got == pytest.approx(1 - 2 * area, abs=1e-9 if df < 1e6 else 1e-8)
    one = spark.createDataFrame([(2.0, 3.0, 0.4)], "a double, b double, x double")
    assert one.select(incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).first()[0] == pytest.approx(0.5248, abs=1e-12)
    assert one.select(log_gamma(F.lit(0.5))).first()[0] == pytest.approx(math.log(math.pi) / 2, abs=1e-12)


def test_ab_runs_and_p_value(spark):
    rows = spark.createDataFrame([("q1", "a", 0.4), ("q2", "a", 0.4), ("q1", "b", 0.7), ("q2", "b", 0.7), ("q1", "other", 9.0)], "question_id string, variant string, score double")
    r = evaluate.compared(evaluate.ab_runs(lambda k: rows, ("a", "b"), 2)).first()
    assert (r["n_a"], r["n_b"], r["winner"], r["p_value"]) == (4, 4, "b", None) and r["mean_a"] == pytest.approx(0.4)
    wide = lambda k: spark.createDataFrame([(f"q{i}", v, float(i % 3 + (v == "b") * 0.5 + k)) for i in range(10) for v in "ab"] + [("x", "a", 1.0)], "question_id string, variant string, score double")
    r = evaluate.compared(evaluate.ab_runs(wide, ("a", "b"), 3)).first()
    a = [i % 3 + k for k in range(3) for i in range(10)] + [1.0] * 3
    b = [i % 3 + k + 0.5 for k in range(3) for i in range(10)] + [0.0] * 3
    va, vb = np.var(a, ddof=1) / 33, np.var(b, ddof=1) / 33
    assert r["n_a"] == 33 and r["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb)) and 0 < r["p_value"] < 1
    assert r["df"] == pytest.approx((va + vb) ** 2 / (va * va / 32 + vb * vb / 32))
    single = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0)], "question_id string, variant string, score double")
    assert evaluate.compared(evaluate.ab_runs(lambda k: single, ("a", "b"))).first()["p_value"] is None
    with pytest.raises(ValueError):
        evaluate.ab_runs(lambda k: single, ("a", "b"), 0)


def test_unique_questions_as_if_one_by_one(spark):
    rng = random.Random(7)
    for _ in range(6):
        texts = ["Why?", "why? ", "Why? (2)", "why?  (3)", "How", "how (1)", "How (1) (1)"]
        drafts = [(k // 20, k % 20, rng.choice(texts)) for k in range(60)]
        seen, want = set(), {}
        for k, idx, q in drafts:
            base, n = q.strip(), idx + 1
            name = base
            while " ".join(name.lower().split()) in seen:
                name, n = f"{base} ({n})", n + 1
            seen.add(" ".join(name.lower().split()))
            want[k, idx] = name
        got = evaluate.unique_questions(spark.createDataFrame(drafts, "k int, idx long, question string"), ["k", "idx"]).collect()
        assert {(r["k"], r["idx"]): r["question"] for r in got} == want


def test_many_equal_questions_are_numbered_in_few_rounds(spark, monkeypatch):
    rng, fixed, calls = random.Random(3), evaluate.fixed, []
    monkeypatch.setattr(evaluate, "fixed", lambda df: calls.append(1) or fixed(df))
    texts = ["Why?"] * 9 + ["why? (40)", "Why? (4)", "Why? (4) (1)", "(3)", "", None, "Why?(2)", "Why? (07)"]
    drafts = [(n % 3, n, (n * 7) % 5 if n % 50 else 100 * (n % 7), rng.choice(texts)) for n in range(900)]
    taken, want = set(), {}
    for k, idx, seed, q in sorted(drafts, key=lambda d: d[:2]):
        name, n = q, seed + 1
        while q is not None and " ".join(name.lower().split()) in taken:
            name, n = f"{q} ({n})", n + 1
        taken |= {" ".join(name.lower().split())} if q is not None else set()
        want[k, idx] = name
    df = spark.createDataFrame(drafts, "k int, idx long, seed int, question string").repartition(7)
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *c, whole=DataFrame.repartitionByRange: whole(df, 5, *c))
    got = evaluate.unique_questions(df, ["k", "idx"], seed="seed").collect()
    assert {(r["k"], r["idx"]): r["question"] for r in got} == want and len(got) == 900
    assert len(calls) < 40


def test_experiment_means_with_latency(spark, tmp_path):
    metrics = observability.Metrics(spark, "run", str(tmp_path / "m"))
    with metrics.timer("e1"):
        rows = spark.createDataFrame([("e1", "q1", 1.0, None), ("e1", "q2", 0.0, 0.5), ("e2", "q1", 0.5, 0.5)], "exp_id string, question_id string, recall_at_5 double, faithfulness_proxy double")
        rows = rows.withColumns({m: F.lit(0.25) for m in evaluate.MEANS if m not in rows.columns})
        rows.count()
    got = {r["exp_id"]: r for r in evaluate.experiment_means(rows, observability.metric_rows(spark, metrics.path)).collect()}
    assert got["e1"]["recall_at_5"] == 0.5 and got["e1"]["faithfulness_proxy"] == 0.25 and got["e2"]["ndcg_at_10"] == 0.25
    assert got["e1"]["latency_ms"] > 0 and got["e2"]["latency_ms"] is None
