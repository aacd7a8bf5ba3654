import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answer, cleaning, evaluate, graph, retrieval, store, vectors
from lodestone.sources import files, sinks
from lodestone.streaming import metrics


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.7, 0.7]), (2, [0.0, 1.0])], "row_idx long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, query array<float>")
    hits = vectors.cosine_search(q, v, 3).orderBy("rank").collect()
    assert [h["row_idx"] for h in hits] == [0, 1, 2] and hits[0]["score"] >= hits[1]["score"] >= hits[2]["score"]


def test_dense_and_sparse_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "")], "id long, text string")
    dense = {r["id"]: r["v"] for r in df.select("id", vectors.dense_embedding(F.col("text"), 16).alias("v")).collect()}
    for r in vectors.sparse_embedding(df, "id", "text", 16).collect():
        assert dense[r["id"]][r["idx"]] == pytest.approx(r["weight"])
    assert not any(dense[2])


def test_fusion(spark):
    schema = "question_id string, chunk_id string, rank int, score double"
    a = spark.createDataFrame([("q", "c1", 1, 0.8), ("q", "c2", 2, 0.7), ("q", "c4", 3, -0.5)], schema)
    b = spark.createDataFrame([("q", "c3", 1, 0.9), ("q", "c1", 2, 0.4)], schema)
    got = retrieval.fused(a, b, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == [("c1", 0.64), ("c2", 0.42), ("c3", 0.36)]


def test_rerank(spark):
    hits = spark.createDataFrame([("q", f"c{k}", k) for k in (1, 2, 3)], "question_id string, chunk_id string, rank int")
    reply = lambda raw: spark.createDataFrame([("q", raw)], "question_id string, raw string")
    order = lambda raw: [(r["chunk_id"], r["status"]) for r in retrieval.reranked(hits, reply(raw)).orderBy("rank").collect()]
    assert order('{"ranked_chunk_ids": ["c2", "unknown", "c2"]}') == [(c, "partial_ids") for c in ("c2", "c1", "c3")]
    assert order('{"ranked_chunk_ids": ["c3", "c1", "c2"]}') == [(c, "ok") for c in ("c3", "c1", "c2")]
    assert order('{"ranked_chunk_ids": ["c3"]}') == [(c, "ok") for c in ("c3", "c1", "c2")]
    for raw in ('{"ranked_chunk_ids": []}', '{"ranked_chunk_ids": [1]}', '{"ranked_chunk_ids": ["c1"], "more": 1}', "[]", '{"ranked_chunk_ids": null}'):
        assert order(raw) == [(c, "invalid_schema") for c in ("c1", "c2", "c3")]
    assert order("not json")[0] == ("c1", "invalid_json") and order('{"x": 1}')[0] == ("c1", "invalid_schema")


def test_graph(spark):
    chunks = spark.createDataFrame([("c1", "Scope change requires risk mitigation plan."), ("c2", "Risk mitigation plan controls cost overrun."), ("c3", "Rain causes floods")], "chunk_id string, chunk_text string")
    found = graph.triples(chunks)
    assert {(r["source"], r["relation"], r["target"]) for r in found.where("chunk_id = 'c3'").collect()} == {("rain", "causes", "floods"), ("rain ca", "uses", "floods")}
    q = spark.createDataFrame([("q", "What about scope change?")], "question_id string, question string")
    hits = {r["chunk_id"]: r["score"] for r in graph.graph_search(q, graph.nodes(found), graph.edges(found), 8).collect()}
    assert hits == {"c1": 1.0, "c2": 0.5}
    assert graph.counts(graph.nodes(found), graph.edges(found), graph.mentions(found)).first()["edges"] == 4


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "question_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, chunk_id string")
    assert evaluate.ranking_metrics(hits, gold, 2).first()["recall"] == 0.5
    assert evaluate.ranking_metrics(hits, gold, 3).first()["ndcg"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert evaluate.citation_precision(hits.where("rank < 3"), gold).first()["precision"] == 0.5
    said = spark.createDataFrame([("q", "one two three four")], "question_id string, answer_text string")
    chunk = spark.createDataFrame([("a", "One two")], "chunk_id string, chunk_text string")
    assert evaluate.faithfulness(said, hits.where("rank = 1"), chunk).first()["faithfulness"] == 0.5


def test_targets_grid_and_comparison(spark):
    assert rows(evaluate.type_targets(spark, 200)) == [("contrast", 40), ("fact", 90), ("multi_hop", 70)]
    assert rows(evaluate.type_targets(spark, 20)) == [("contrast", 4), ("fact", 9), ("multi_hop", 7)]
    with pytest.raises(ValueError):
        evaluate.type_targets(spark, 0)
    assert evaluate.grid(spark, list("abcd"), list("xyz"), list("pqr")).select("exp_id").distinct().count() == 36
    named = {r["exp_id"] for r in evaluate.grid(spark, ["a"], ["b"], ["vector"], ["local", "remote"], [False, True], ["m1"]).collect()}
    assert named == {"exp_a_b_vector", "exp_a_b_vector_provider_remote", "exp_a_b_vector_reranker_m1", "exp_a_b_vector_provider_remote_reranker_m1"}
    s = spark.createDataFrame([("x", 0.4)] * 4 + [("y", 0.7)] * 4, "variant string, score double")
    r = evaluate.compared(s).first()
    assert (r["mean_a"], r["mean_b"], r["winner"], r["n_a"]) == (pytest.approx(0.4), pytest.approx(0.7), "y", 4)


def test_answer(spark):
    chunks = spark.createDataFrame([("c1", 1, 1, "S", "First one. Second."), ("c2", 1, 1, "S", "")], "chunk_id string, doc_id int, page int, section string, chunk_text string")
    hits = spark.createDataFrame([("q", "c1", 1, 0.5), ("q", "c1", 2, 0.4), ("q", "c2", 3, 0.1), ("q", "gone", 4, 0.1)], "question_id string, chunk_id string, rank int, score double")
    trace = answer.traced(hits, chunks)
    assert rows(answer.answers(trace)) == [("q", "First one.", ["c1"])]
    assert trace.first()["support"] > 0


def test_repeated_lines(spark):
    three = spark.createDataFrame([("d", k, f"Head\nown {k}") for k in (1, 2, 3)], "doc_id string, page int, text string")
    assert rows(cleaning.without_repeated_lines(three, threshold=0.66)) == [("d", k, f"own {k}") for k in (1, 2, 3)]
    assert rows(cleaning.without_repeated_lines(three.where("page < 3"), threshold=0.66)) == [("d", k, f"Head\nown {k}") for k in (1, 2)]
    with pytest.raises(ValueError):
        cleaning.without_repeated_lines(three, threshold=1.5)


def test_contents(spark):
    lines = spark.createDataFrame([("d", 0, "1 Scope .... 3"), ("d", 1, "1.1 Plan .... 5"), ("d", 2, "1.1.1 Deep   v"), ("d", 3, "2 Risk .... x"), ("d", 4, "no entry here")], "doc_id string, pos int, line string")
    entries = cleaning.contents_paths(cleaning.contents_entries(lines))
    paths = {r["title"]: (r["page"], r["path"]) for r in entries.collect()}
    assert paths == {"Scope": (3, "Scope"), "Plan": (5, "Scope / Plan"), "Deep": (5, "Scope / Plan / Deep"), "Risk ....": (10, "Risk ....")}
    pages = spark.createDataFrame([("d", p) for p in (1, 4, 7, 50)], "doc_id string, page int")
    assert {r["page"]: r["path"] for r in cleaning.section_as_of(pages, entries).collect()} == {1: "Scope", 4: "Scope", 7: "Scope / Plan / Deep", 50: "Risk ...."}


def test_paragraphs_and_sections(spark):
    text = "# Top\nplain one\nplain two\n\n- item\n  goes on\n```\ncode  x\n```\n| a | b |"
    lines = cleaning.numbered_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["doc_id"])
    got = [r["text"] for r in cleaning.paragraphs(lines).orderBy("block").collect()]
    assert got == ["# Top", "plain one plain two", "- item goes on", "```", "code  x", "```", "| a | b |"]


def test_store(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id int, text string")
    have = spark.createDataFrame([("y",)], "t string").select(F.sha2("t", 256).alias("sha256"))
    assert [r["doc_id"] for r in store.additions(new, have, "text", F.col("doc_id")).collect()] == [1]
    meta = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "chunk_id string, row_idx long")
    left = spark.createDataFrame([("a",), ("c",)], "chunk_id string")
    assert rows(store.realigned(meta, left).select("chunk_id", "row_idx")) == [("a", 0), ("c", 1)]
    assert rows(store.appended(meta, meta.limit(1))) == [("a", 0), ("a", 3), ("b", 1), ("c", 2)]
    runs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 2), ("r0", 0)], "run_id string, mtime int")
    assert {r["run_id"] for r in store.retention(runs, 2, ["r0"]).where("retained").collect()} == {"r2", "r3", "r0"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes("Title Here\nx\fPage two\f \f".encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4 \xff bytes")
    found = files.files(spark, str(tmp_path / "in"))
    plain = files.pages(found)
    assert plain.count() == 3
    parsed = files.pages(found, lambda content: ["parsed one", "parsed two"])
    assert {r["text"] for r in parsed.collect()} == {"Title Here", "Page two", "parsed one", "parsed two"}
    assert {r["text"] for r in files.raw_pages(found).where("text LIKE 'Title%'").collect()} == {"Title Here\nx"}
    titles = {r["title"] for r in files.documents(found, plain).collect()}
    assert "Title Here" in titles
    sinks.overwritten(plain, str(tmp_path / "run" / "chunks.parquet"))
    assert files.run_names(spark, str(tmp_path)) == ["run"]
    assert files.typed(spark, str(tmp_path / "run" / "chunks.parquet"), plain.schema).count() == 3
    sinks.logged(plain, str(tmp_path / "log"))
    sinks.logged(plain, str(tmp_path / "log"))
    assert files.json_lines(spark, str(tmp_path / "log"), plain.schema).count() == 6
    assert "| doc_id | page | text |" in sinks.report(plain, "Pages")


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("LODESTONE_TOP_K", "5")
    monkeypatch.setenv("LODESTONE_RERANKER_ENABLED", "yes")
    s = files.settings(graph_depth=3)
    assert (s.top_k, s.reranker_enabled, s.graph_depth, s.chunk_size) == (5, True, 3, 512)


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run = metrics.rolled_up(stream).writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    try:
        run.processAllAvailable()
        assert rows(spark.table("rolled")) == rows(metrics.rolled_up(events))
    finally:
        run.stop()
