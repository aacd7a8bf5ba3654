import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cleaning, evaluate, jobs, store
from lodestone.sources import files, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ingest_index_graph_and_answers(spark, tmp_path):
    (tmp_path / "a_pmbok.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes("Scope change requires risk mitigation plan.\n12\fRisk mitigation plan controls cost overrun.".encode())
    book = ["Contents\n1 Scope 2\n1.1 Plan ..... 3", "Scope text here.\nkey  value\nplan  9", "Deep text of the plan."]
    found = files.files(spark, str(tmp_path))
    raw = evaluate.fixed(files.raw_pages(found, lambda content: book))
    out = jobs.ingested(found, raw, "fixed", size=50, overlap=5)
    assert out.documents.count() == 2
    got = {(r["page"], r["chunk_type"]): (r["section"], r["section_path"]) for r in out.chunks.where("section_path <> ''").collect()}
    assert got[2, "text"] == ("Scope", "Scope") and got[3, "text"] == ("Scope / Plan", "Scope / Plan") and got[2, "table"] == ("Scope", "Scope")
    assert got[1, "text"][1] == "Page 1"
    plain = out.chunks.where("section_path = ''")
    assert rows(plain.select("page", "chunk_text"))[0] == (1, "Scope change requires risk mitigation plan.")
    index = jobs.index(plain, dimensions=16).collect()
    assert sorted(r["row_idx"] for r in index) == [0, 1] and all(len(r["embedding"]) == 16 for r in index)
    q = spark.createDataFrame([("q", "What about scope change?")], "question_id string, question string")
    built = jobs.graph_of(plain)
    said = jobs.answered(q, plain, "graph", built=built).first()
    assert said["answer_text"].startswith("Scope change requires") and len(said["citations"]) == 2
    assert jobs.answered(q, plain, "hybrid").first()["citations"] == jobs.answered(q, plain, "vector").first()["citations"]
    reply = spark.createDataFrame([("q", json.dumps({"ranked_chunk_ids": [said["citations"][1]]}))], "question_id string, raw string")
    assert jobs.answered(q, plain, "graph", k=1, built=built, replies=reply).first()["citations"] == [said["citations"][1]]
    assert jobs.smoke_answers(q, plain).first()["excerpt"].startswith("Scope change")
    with pytest.raises(ValueError):
        jobs.answered(q, plain, "other")
    assert jobs.provider_of("Local-Hash") == "local_hash"
    with pytest.raises(ValueError):
        jobs.provider_of("unknown")


def test_evidence_of_chunks_that_are_gone(spark):
    chunks = spark.createDataFrame([("c1", "Scope change requires risk plan."), ("c2", "Risk plan controls cost overrun.")], "chunk_id string, chunk_text string")
    q = spark.createDataFrame([("q", "What about scope change?")], "question_id string, question string")
    hits = jobs.retrieved(q, chunks.where("chunk_id = 'c1'"), "graph", 8, jobs.graph_of(chunks))
    assert [r["chunk_id"] for r in hits.collect()] == ["c1"]


def test_tables_of_a_page(spark):
    page = spark.createDataFrame([("d", 1, "| a | b |\n|---|---|\n| 1 | 2 |\nx\nleft  right\nnext  3|4")], "doc_id string, page int, text string")
    got = {r["table_id"]: r["markdown"] for r in cleaning.page_tables(page).collect()}
    assert got["p1-t1"] == "|  | a | b |  |\n| --- | --- | --- | --- |\n|  | --- | --- |  |\n|  | 1 | 2 |  |"
    assert got["p1-t2"] == "| left | right |\n| --- | --- |\n| next | 3\\|4 |"


def test_metrics_of_every_question(spark):
    q = spark.createDataFrame([("q",), ("none",)], "question_id string")
    hits = spark.createDataFrame([("q", "a", 1, 0.5)], "question_id string, chunk_id string, rank int, score double")
    gold = spark.createDataFrame([("q", "a")], "question_id string, chunk_id string")
    said = spark.createDataFrame([("q", "one two")], "question_id string, answer_text string")
    chunks = spark.createDataFrame([("a", "One two")], "chunk_id string, chunk_text string")
    assert rows(evaluate.query_metrics(q, hits, gold, hits, said, chunks, 5)) == [("none", 0.0, 0.0, 0.0, 0.0), ("q", 1.0, 1.0, 1.0, 1.0)]
    scores = spark.createDataFrame([("q", 8.0), ("q", None)], "question_id string, score double")
    assert evaluate.judge_means(scores).first()["avg_score"] == 4.0


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"run_id": "r", "rows": [{"exp_id": "e1", "ndcg_at_10": 0.5}, 3, {"exp_id": "e2", "ndcg_at_10": 0.7}]}))
    matrix = files.matrix_rows(spark, str(tmp_path / "m.json"), spark.createDataFrame([], "exp_id string, ndcg_at_10 double").schema)
    assert rows(matrix) == [("r", "e1", 0.5), ("r", "e2", 0.7)]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.matrix_rows(spark, str(tmp_path / "bad.json"), matrix.schema)
    sinks.matrix_files(matrix, str(tmp_path / "out"))
    again = files.csv_rows(spark, str(tmp_path / "out" / "matrix.csv"))
    assert again.columns == sinks.MATRIX_COLUMNS and again.count() == 2
    assert spark.read.json(str(tmp_path / "out" / "matrix.json")).first()["summary"]["best_exp_id"] == "e2"
    sinks.json_lines(matrix, str(tmp_path / "lines"))
    sinks.json_lines(matrix, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    (tmp_path / "c.yaml").write_text("")
    assert files.mapping(str(tmp_path / "c.yaml")) == {}
    (tmp_path / "c.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        files.mapping(str(tmp_path / "c.yaml"))
    assert files.table_or_empty(spark, str(tmp_path / "none"), matrix.schema).count() == 0


def test_life_of_a_store(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "t"), ("d2", "u")], "doc_id string, title string")
    path = sinks.store_created(spark, str(tmp_path), "store-1", {"chunks": docs.schema})
    assert files.newest_run(spark, str(tmp_path)) == "store-1"
    with pytest.raises(FileExistsError):
        sinks.store_created(spark, str(tmp_path), "store-1", {})
    with pytest.raises(ValueError):
        sinks.store_created(spark, str(tmp_path), "../x", {})
    sinks.replaced(docs, f"{path}/chunks.parquet")
    sinks.replaced(files.typed(spark, f"{path}/chunks.parquet", docs.schema).where("doc_id = 'd1'"), f"{path}/chunks.parquet")
    assert rows(files.typed(spark, f"{path}/chunks.parquet", docs.schema)) == [("d1", "t")]
    assert sinks.store_deleted(spark, str(tmp_path), "store-1") and not sinks.store_deleted(spark, str(tmp_path), "store-1")
    chunks = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, chunk_id string")
    meta = spark.createDataFrame([("a", 0), ("b", 1)], "chunk_id string, row_idx long")
    assert store.document_removed("d9", docs, docs, chunks, meta) is None
    left = store.document_removed("d1", docs, docs, chunks, meta)
    assert rows(left[2]) == [("d2", "b")] and rows(left[3].select("chunk_id", "row_idx")) == [("b", 0)]
    assert store.aligned(meta, chunks).count() == 2
    with pytest.raises(Exception, match="unknown chunk_id: b"):
        store.aligned(meta, chunks.where("doc_id = 'd1'")).count()
    twice = chunks.unionByName(spark.createDataFrame([("d0", "a"), ("d3", "a")], "doc_id string, chunk_id string"))
    assert [tuple(r) for r in store.aligned(meta, twice).orderBy("row_idx").collect()] == [("a", 0, "d3"), ("b", 1, "d2")]


def test_heading_without_cased_letters(spark):
    from lodestone.operators import chunking

    lines = spark.createDataFrame([("12",), ("第一章",), ("plain words",), ("Title Case",)], "line string")
    assert [r[0] for r in lines.select(chunking.is_heading(F.col("line"))).collect()] == [True, True, False, True]
