import pytest

from pyspark.sql import functions as F

from lodestone.operators import answer, cleaning, evaluate, graph, jobs, retrieval, vectors
from lodestone.operators.vectors import top_k
from lodestone.sources.shared import fixed


def words(n, *sizes):
    return " ".join(f"w{(n * 7 + s) % 11}" for s in sizes)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(f"q{n}", words(n, 0, 1, 3)) for n in range(9)] + [("none", "unseen"), ("empty", None)], "question_id string, question string")


def test_candidates_of_batches_hold_the_best_of_all_pairs(spark, asked):
    chunks = [(f"c{n}", f"d{n % 7}" if n % 5 else None, n % 3, words(n, 2) if n % 4 else None, words(n, *range(n % 6)) if n % 9 else None) for n in range(300)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, doc_id string, page int, section string, chunk_text string").repartition(3)
    k, experiments = 5, evaluate.grid(spark, ["fixed"], ["hash-small"], ["vector", "graph", "hybrid"])
    some = evaluate.base_candidates(asked, chunks, k)
    assert some.count() <= 11 * 3 * 2 * k
    best = [sorted(map(tuple, evaluate.matrix_hits(base, experiments, k).collect())) for base in (some, evaluate.base_scores(asked, chunks))]
    assert best[0] == best[1] and len(best[0]) == 3 * 11 * k


def test_equal_sets_are_searched_for_once(spark):
    cues = ["affects", "uses", "controls"]
    chunks = [(f"c{n:03}", f"alpha beta{n % 4} {cues[n % 3]} gamma{n % 3} delta{n % 2}.") for n in range(240)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, chunk_text string")
    questions = [(n, f"what {'beta' if n % 2 else 'gamma'}{n % 3} {'Alpha delta0' if n % 5 else 'delta0 alpha'}") for n in range(60)] + [(99, "nothing known")]
    questions = spark.createDataFrame(questions, "question_id int, question string")
    found = graph.triples(chunks)
    nodes, edges = fixed(graph.nodes(found)), fixed(graph.edges(found))
    k = 7
    # the plain way: every edge a question reaches with every chunk that it is evidence of
    each = graph.walked(questions, nodes, edges).join(edges, "edge_id").select("question_id", "depth", "weight", F.explode("evidence_chunk_ids").alias("chunk_id"))
    scored = each.groupBy("question_id", "chunk_id").agg(F.sum(F.col("weight") / F.col("depth")).alias("score"), F.min("depth").alias("depth"))
    want = top_k(scored, k, order=[F.col("depth"), F.col("chunk_id")]).select("question_id", "rank", "chunk_id", "score")
    got = graph.graph_search(questions, nodes, edges, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert retrieval.alike(questions).select("__set").distinct().count() == 7
    pairs = [tuple(r)[1:] for r in retrieval.lexical_search(questions, chunks, k).orderBy("question_id", "rank").where("question_id in (1, 7)").collect()]
    assert pairs[:k] == pairs[k:] and len(pairs) == 2 * k


def test_vectors_are_made_where_texts_are(spark):
    texts = [None, "", "...", "a b a", "It's a_b; 7 Ünï", *(words(n, *range(n % 40)) for n in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dimensions in (3, 256):
        some = vectors.embedded(df, "text", dimensions, dense=True)
        want = {r["id"]: r["e"] for r in df.select("id", vectors.dense_embedding(F.col("text"), dimensions).alias("e")).collect()}
        assert all(r["embedding"] == pytest.approx(want[r["id"]], abs=1e-12) for r in some.collect())
        sparse = vectors.sparse_embedding(df, "id", "text", dimensions)
        assert "Exchange" not in sparse._jdf.queryExecution().executedPlan().toString()
        assert {(r["id"], r["idx"]): pytest.approx(r["weight"]) for r in sparse.collect()} == {(n, k): x for n, v in want.items() for k, x in enumerate(v) if x}


def test_cosine_of_all_pairs_by_products(spark):
    rows = [(n, [float((n * k) % 7 - 3) for k in range(1, 5 if n % 10 else 4)]) for n in range(400)] + [(400, None), (401, [1.0, None, 1.0, 2.0]), (402, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "row_idx long, embedding array<float>").repartition(5)
    asked = df.where("row_idx % 50 = 3 or row_idx % 100 = 0").select(F.col("row_idx").alias("question_id"), F.col("embedding").alias("query"))
    hits = vectors.cosine_search(asked, df, 6)
    assert "BroadcastNestedLoopJoin" not in (plan := hits._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan and "MapInArrow" in plan
    good, want = [(n, v) for n, v in rows if n < 400], []
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q, a in good:
        if q % 50 == 3 or q % 100 == 0:
            scored = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / max(norm(a) * norm(b), 1e-8), 9), n) for n, b in good if len(a) == len(b))
            want += [(q, rank, n) for rank, (_, n) in enumerate(scored[:6], 1)]
    assert sorted((r["question_id"], r["rank"], r["row_idx"]) for r in hits.collect()) == sorted(want)


def test_chunks_are_numbered_once_for_all_kinds(spark, monkeypatch):
    calls, numbered = [], evaluate.numbered
    monkeypatch.setattr(evaluate, "numbered", lambda chunks: calls.append(1) or numbered(chunks))
    chunks = spark.createDataFrame([(f"c{n}", f"d{n % 3}", 1, f"s{n}", words(n, 1, 2, 3)) for n in range(9)], "chunk_id string, doc_id string, page int, section string, chunk_text string")
    assert evaluate.generated_questions(spark, chunks, "run", 20).count() == 20 and len(calls) == 1


def test_texts_of_short_documents_stay_where_they_are(spark):
    pages = [("one", 1, " Head \nown"), ("two", 1, "Head\na"), ("two", 2, "Head\nb"), *(("three", k, f"Head\nown {k}\n\n") for k in (1, 2, 3)), ("none", 1, " \n"), ("null", 1, None), (None, 1, "x"), ("same", 1, "a\nb"), ("same", 1, "a\nc")]
    pages = spark.createDataFrame(pages, "doc_id string, page int, text string")
    want = sorted([("one", 1, "Head\nown"), ("two", 1, "Head\na"), ("two", 2, "Head\nb"), *(("three", k, f"own {k}") for k in (1, 2, 3)), ("none", 1, "(empty page)"), ("null", 1, "(empty page)"), ("None", 1, "(empty page)"), *[("same", 1, "a\na\nb\nc")] * 2])
    got = [(str(r["doc_id"]), r["page"], r["text"]) for r in cleaning.without_repeated_lines(pages).collect()]
    assert sorted(got) == want
    short = cleaning.without_repeated_lines(pages.where("doc_id in ('one', 'two', 'none')"))
    assert "hashpartitioning" not in short._jdf.queryExecution().executedPlan().toString()


def test_numbering_moves_rows_once(spark):
    rows = spark.createDataFrame([(f"d{n % 7}", n % 3, "s", f"c{n:03}") for n in range(200)], "doc_id string, page int, section string, chunk_id string").repartition(5)
    numbered = evaluate.numbered(rows)
    assert "hashpartitioning(__p" not in numbered.drop("at")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = [tuple(r)[:4] for r in sorted(numbered.select("doc_id", "page", "section", "chunk_id", "at").collect(), key=lambda r: r["at"])]
    assert got == sorted(got) and [r["at"] for r in numbered.orderBy("at").collect()] == list(range(200))


def test_smoke_cuts_chunks_once(spark, asked):
    raw = spark.createDataFrame([(f"d{n}", 1, words(n, *range(n % 6)), False) for n in range(50)], "doc_id string, page int, text string, parsed boolean")
    out = jobs.smoke(asked, raw)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 11


def test_hits_go_to_the_texts(spark, asked):
    chunks = spark.createDataFrame([(f"c{n}", f"d{n}", 1, "s", words(n, *range(n % 6)) + ".") for n in range(60)], "chunk_id string, doc_id string, page int, section string, chunk_text string")
    trace = answer.traced(retrieval.lexical_search(asked, chunks, 4), chunks)
    score = evaluate.faithfulness(answer.answers(trace), trace, chunks)
    for df in (trace, score):
        assert "hashpartitioning(chunk_id" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin [chunk_id" in plan
    assert {r["question_id"] for r in score.collect()} >= {f"q{n}" for n in range(9)}
