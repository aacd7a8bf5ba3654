import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluate, images, jobs
from lodestone.sources import files, sinks


def test_settings_from_all_sides(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("top_k: 3\nbreakpoint: 0.5\nreranker_enabled: yes\n")
    monkeypatch.setenv("LODESTONE_TOP_K", "4")
    monkeypatch.setenv("LODESTONE_EMBEDDING_DIM", "")
    monkeypatch.setenv("LODESTONE_ANSWER_LOCAL", " T ")
    s = files.settings(str(tmp_path / "s.yaml"), graph_depth=3, graph_weight=None)
    assert (s.top_k, s.breakpoint, s.reranker_enabled, s.embedding_dim, s.answer_local, s.graph_depth, s.graph_weight) == (4, 0.5, True, 256, True, 3, 0.4)
    assert files.settings(str(tmp_path / "none.yaml")).top_k == 4
    for bad in ({"top_k": 0}, {"top_k": "many"}, {"breakpoint": 1.5}, {"model_timeout": 0}, {"embedding_provider": "x"}, {"answer_model": " "}, {"reranker_enabled": "perhaps"}, {"no_such": 1}, {"top_k": 2.5}, {"top_k": True}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            files.settings(**bad)
    monkeypatch.setenv("LODESTONE_TOP_K", "junk")
    with pytest.raises(ValueError, match="top_k"):
        files.settings()


def test_where_chunks_and_questions_come_from(spark, tmp_path):
    def run(root, name, time, holding="chunks.parquet"):
        (tmp_path / root / name).mkdir(parents=True)
        (tmp_path / root / name / holding).write_text("x")
        os.utime(tmp_path / root / name, (time, time))

    for root, name, time in (("a", "old", 100), ("a", "new", 200), ("b", "run", 50), ("b", "later", 300)):
        run(root, name, time)
    (tmp_path / "a" / "empty").mkdir()
    root = lambda x: str(tmp_path / x)
    of = lambda config, name="run", top="a": files.resolved_source(spark, name, config, root(top)).rsplit("/", 2)[1:]
    assert of({"source_run_id": " any "}) == ["a", "any"] and of({"source_artifact_dir": "/x/y"}) == ["x", "y"]
    assert of({"source_artifacts": [3, root("none"), root("b")]}) == ["b", "run"] and of({"source_artifacts": [root("b")]}, "other") == ["b", "later"]
    assert of({}, "old") == ["a", "old"] and of({"source_run_id": " "}) == ["a", "new"]
    with pytest.raises(FileNotFoundError):
        of({}, top="none")
    for name in ("questions_1.jsonl", "questions_2.jsonl"):
        (tmp_path / "a" / "old" / name).write_text("")
    asked = lambda config, given=None, name="old": files.resolved_questions(spark, name, config, root("a"), given).rsplit("/", 1)[-1]
    assert asked({}) == "questions_2.jsonl" and asked({"questions_path": "q"}) == "q" and asked({"dataset_path": "d", "questions_path": "q"}) == "d" and asked({"dataset_path": "d"}, "g") == "g"
    with pytest.raises(FileNotFoundError):
        asked({}, name="new")


def test_old_runs_are_removed(spark, tmp_path):
    for k, name in enumerate(["r1", "r2", "r3", "r4"]):
        (tmp_path / "runs" / name).mkdir(parents=True)
        os.utime(tmp_path / "runs" / name, (100 + k // 2, 100 + k // 2))
    (tmp_path / "runs" / "file").write_text("")
    state = lambda **x: {r["run_id"]: r["state"] for r in sinks.runs_removed(spark, str(tmp_path / "runs"), **x).collect()}
    assert state(keep_latest=1, keep=["r2", "gone"]) == {"r1": "candidate", "r2": "retained", "r3": "retained", "r4": "candidate", "gone": "missing"}
    assert (tmp_path / "runs" / "r1").exists()
    assert state(keep_latest=1, keep=["r2"], dry_run=False) == {"r1": "deleted", "r2": "retained", "r3": "retained", "r4": "deleted"}
    assert sorted(os.listdir(tmp_path / "runs")) == ["file", "r2", "r3"] and state(keep_latest=3) == {"r2": "retained", "r3": "retained"}
    assert sinks.runs_removed(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(NotADirectoryError):
        sinks.runs_removed(spark, str(tmp_path / "runs" / "file"))


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 0.5, 0.5, 9.0), ("e2", 0.5, 0.5, 3.0), ("e3", 0.9, None, 1.0)], "exp_id string, ndcg_at_10 double, recall_at_10 double, latency_ms double")
    text = sinks.leaderboard_report(rows, "run")
    assert [x.split(" | ")[1] for x in text.split("\n") if x.startswith("| ") and "e" in x.split(" | ")[1] and "Exp" not in x] == ["e3", "e2", "e1"]
    assert "| 1 | e3 | 0.9000 | 0.0000 | 0.0000 | 0.0000 | 1.00 |" in text
    with pytest.raises(ValueError):
        sinks.leaderboard_report(rows.where("false"), "run")
    scores = spark.createDataFrame([("a", x) for x in (0.4, 0.4)] + [("b", x) for x in (0.8, 0.8)], "variant string, score double")
    text = sinks.ab_report(evaluate.compared(scores), "recall")
    assert "p-value: N/A" in text and "Winner: b" in text and "50.0% better" in text
    assert '"recall_at_10": 0.0' in sinks.demo_report("run", {"mode": "hybrid"}, {"ndcg_at_10": 0.5}, "The answer.")
    sinks.written_text(spark, str(tmp_path / "r.md"), "täxt")
    assert (tmp_path / "r.md").read_text() == "täxt"


def test_image_index(spark):
    captions = spark.createDataFrame([("a process flow", "p2.png", 2), ("cost over time", "p1.png", 1), (None, "p3.png", 3), ("cost over time", "p1.png", 1)], "caption string, image_ref string, page int")
    index = images.image_index(captions, 64)
    assert [(r["row_idx"], r["chunk_id"], r["page"]) for r in index.orderBy("row_idx").collect()] == [(0, "img_0", 1), (1, "img_1", 1), (2, "img_2", 2), (3, "img_3", 3)]
    hits = images.image_search(spark.createDataFrame([("q", "flow of a process")], "question_id string, question string"), index, 2, 64).orderBy("rank").collect()
    assert hits[0]["image_ref"] == "p2.png" and hits[0]["score"] > 0.5 and len(hits) == 2


def test_markdown_chunks_are_numbered_through_a_document(spark):
    content = [" ".join(f"w{k}" for k in range(n)) for n in (5, 0, 11, 10, 4)]
    rows = spark.createDataFrame([("d", k, 1, f"path {k}", c) for k, c in enumerate(content, 1)] + [("e", 1, 2, "p", "only\none")], "doc_id string, section_no long, level int, path string, content string")
    got = {(r["doc_id"], r["chunk_id"]): (r["section_path"], r["chunk_text"]) for r in chunking.markdown_chunks(rows, 5, 2).collect()}
    want, n = {("e", "chunk_000000"): ("p", "only\none")}, 0
    for k, c in enumerate(content, 1):
        w, start = c.split(), 0
        while w:
            want["d", f"chunk_{n:06d}"] = (f"path {k}", c if len(w) <= 5 else " ".join(w[start : start + 5]))
            n += 1
            start = min(start + 5, len(w)) - 2
            if len(w) <= 5 or start >= len(w) - 2:
                break
    assert got == want and n > 7


def test_smoke(spark):
    raw = spark.createDataFrame([("d1", 1, "Scope\r\nThe scope of work is fixed.", False), ("d2", 1, "Risk\nRisks are listed.", False)], "doc_id string, page int, text string, parsed boolean")
    q = spark.createDataFrame([("q", "What is the scope of work?")], "question_id string, question string")
    r = jobs.smoke(q, raw).first()
    assert (r["doc_id"], r["page"], r["section"]) == ("d1", 1, "Scope") and r["answer_text"] == "For 'What is the scope of work?', the source states: Scope The scope of work is fixed."
    assert jobs.smoke(q, raw.withColumn("text", F.lit(""))).count() == 1


def test_grids_of_configurations(spark):
    config = {"factors": {"chunking": ["fixed", " "], "embeddings": ["a", "b"], "reranker_enabled": ["Yes", 0]}, "defaults": {"retrieval_modes": ["vector"], "chunking": ["other"]}, "reranker_model": ["m"]}
    got = evaluate.grid_of(spark, config).collect()
    assert len(got) == 4 and {r["exp_id"] for r in got} == {"exp_fixed_a_vector", "exp_fixed_b_vector", "exp_fixed_a_vector_reranker_m", "exp_fixed_b_vector_reranker_m"}
    assert evaluate.grid_of(spark, {"factors": {"embedding": []}}).count() == 36
    with pytest.raises(ValueError, match="perhaps"):
        evaluate.grid_of(spark, {"reranker_enabled": ["perhaps"]})


def test_questions_and_flags(spark, tmp_path):
    from lodestone.functions import text

    (tmp_path / "q.jsonl").write_text('{"question_id": "q1", "type": "fact", "question": "What?", "gold_citations": [{"chunk_id": "c", "doc_id": "d", "page": 1, "section": "s"}]}\n')
    r = evaluate.questions_of(spark, str(tmp_path / "q.jsonl")).first()
    assert (r["question_id"], r["gold_citations"][0]["page"], r["gold_answer"]) == ("q1", 1, None)
    (tmp_path / "bad.jsonl").write_text('{"question_id": "q1", "question": "x"}\n{"question_id": "q2", "question": " "}\n')
    with pytest.raises(Exception, match="at line 2"):
        evaluate.questions_of(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("[]\n")
    with pytest.raises(ValueError, match="no questions"):
        evaluate.questions_of(spark, str(tmp_path / "none.jsonl"))
    words = spark.createDataFrame([("yes",), (" OFF ",)], "x string").select(text.flag_or_error(F.col("x"), "it"))
    assert [r[0] for r in words.collect()] == [True, False]
    with pytest.raises(Exception, match="it is neither true nor false: perhaps"):
        spark.createDataFrame([("perhaps",)], "x string").select(text.flag_or_error(F.col("x"), "it")).collect()


def test_discovery(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.discovered(spark, str(tmp_path / "none"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        files.discovered(spark, str(tmp_path / "in"))
    for name in ("b.pdf", "deep/a.pdf", "c.txt"):
        (tmp_path / "in" / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.discovered(spark, str(tmp_path / "in")).collect()] == ["b.pdf", "a.pdf"]


def test_texts_that_hold_an_item(spark):
    texts = {"c1": "the start a bb ccc dd e the end", "c2": "xa bb ccc dd ey", "c3": "a bb  ccc dd e", "c4": "a bb ccc dd", "c5": "bb", "c6": None}
    items = {"q1": "a bb ccc dd e", "q2": "bb", "q3": "start a bb ccc", "q4": "no such words are here at all"}
    chunks, asked = spark.createDataFrame(list(texts.items()), "chunk_id string, chunk_text string"), spark.createDataFrame(list(items.items()), "question_id string, question string")
    want = {(q, c) for q, i in items.items() for c, t in texts.items() if t and i in t}
    assert {tuple(r) for r in evaluate.holding(chunks, asked).collect()} == want and ("q1", "c2") in want
