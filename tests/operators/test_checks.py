import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import doctor, jobs, retrieval


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"d{k % 2}", k, "S", t) for k, t in enumerate(["scope plan", "risk plan of cost", "quality", ""])], "chunk_id string, doc_id string, page int, section string, chunk_text string")
    return chunks, jobs.index(chunks, dimensions=32).cache()


def test_vector_query(spark, index):
    chunks, embeddings = index
    q = spark.createDataFrame([("q1", "scope plan"), ("q2", "quality")], "question_id string, question string")
    got = jobs.vector_query(q, chunks, embeddings, 2, "Local", "hash", 32).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["rank"], r["chunk_id"], r["page"]) for r in got][0] == ("q1", 1, "c0", 0) and got[0]["score"] == pytest.approx(1)
    assert got[2]["chunk_id"] == "c2" and got[2]["doc_id"] == "d0" and len(got) == 4


@pytest.mark.parametrize(
    ("change", "settings", "says"),
    [
        ({"provider": "IF(row_idx = 0, 'ollama', 'local_hash')"}, {}, "multiple providers"),
        ({"embedding_model": "'m' || row_idx"}, {}, "multiple embedding models"),
        ({"dim": "CAST(row_idx + 32 AS INT)"}, {}, "multiple dimensions"),
        ({"row_idx": "row_idx * 2"}, {}, "numbered from 0"),
        ({"embedding": "slice(embedding, 1, 5)"}, {}, "does not match metadata"),
        ({"provider": "'ollama'"}, {}, "provider mismatch.*local_hash != ollama"),
        ({}, {"model": "other"}, "model mismatch.*other != hash"),
        ({}, {"dimensions": 16}, "dimension mismatch.*16 != 32"),
        ({"chunk_id": "'x' || chunk_id"}, {}, "unknown chunk_id: xc"),
        (None, {}, "missing chunks"),
    ],
)
def test_what_is_wrong_fails_the_query(spark, index, change, settings, says):
    chunks, embeddings = index
    bad = embeddings.where("false") if change is None else embeddings.withColumns({c: F.expr(x) for c, x in change.items()})
    q = spark.createDataFrame([("q1", "scope plan")], "question_id string, question string")
    with pytest.raises(Exception, match=says):
        jobs.vector_query(q, chunks, bad, 2, **{"model": "hash", "dimensions": 32, **settings}).collect()


def test_a_clients_replies(spark):
    hits = spark.createDataFrame([(q, f"c{k}", k, "d", k, "S", 0.5) for q in "abcde" for k in (1, 2)], "question_id string, chunk_id string, rank int, doc_id string, page int, section string, score double")
    chunks = spark.createDataFrame([("c1", "first\ntext " + "x" * 400)], "chunk_id string, chunk_text string")
    questions = spark.createDataFrame([(q, f"question {q}") for q in "abcdef"], "question_id string, question string")
    prompts = retrieval.rerank_prompts(questions, hits, chunks)
    asked = {r["question_id"]: r["prompt"].split("\n") for r in prompts.collect()}
    assert sorted(asked) == list("abcde") and "Question: question a" in asked["a"] and json.loads(asked["a"][-1]) == {"ranked_chunk_ids": ["c1", "c2"]}
    one, two = map(json.loads, asked["a"][-3:-1])
    assert one["text"] == "first text " + "x" * 309 + "..." and (two["chunk_id"], two["text"], two["page"]) == ("c2", "", 2)

    def client(prompt):
        kind = prompt.split("Question: question ")[1][0]
        if kind == "d":
            raise TimeoutError("no answer in time")
        return {"a": '{"ranked_chunk_ids": ["c2", "c1"]}', "b": '{"ranked_chunk_ids": ["c9", "c2"]}', "c": "I think c2", "e": '{"ids": []}'}[kind]

    replies = retrieval.replies_of(prompts, client).unionByName(spark.createDataFrame([("f", "{}", None, "h")], "question_id string, raw string, error string, prompt_hash string"))
    want = {"a": "ok", "b": "partial_ids", "c": "invalid_json", "d": "client_error", "e": "invalid_schema", "f": "no_candidates"}
    trace = {r["question_id"]: r for r in retrieval.rerank_trace(hits, replies, "m", 30).collect()}
    assert {q: r["parse_status"] for q, r in trace.items()} == want and trace["d"]["error"] == "no answer in time" and len(trace["a"]["prompt_hash"]) == 40
    order = {}
    for r in retrieval.reranked(hits, replies).orderBy("question_id", "rank").collect():
        order.setdefault(r["question_id"], []).append(r["chunk_id"])
    assert order == {q: ["c2", "c1"] if q in "ab" else ["c1", "c2"] for q in "abcde"}


def test_doctor(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    good = json.dumps({"answer_text": "a", "citations": [1]})
    (tmp_path / "in dir").mkdir()
    (tmp_path / "in dir" / "a.PDF").write_bytes(b"")
    (tmp_path / "none").mkdir()
    write("ok.jsonl", f"\n{good}\n\n{good}\n")
    write("blank.jsonl", " \n\n")
    write("json.jsonl", f"{good}\n\n{{bad\n[1]")
    write("list.jsonl", f'{{"answer_text": " "}}\n[1]\n{good}')
    write("text.jsonl", f'{good}\n\n{{"answer_text": 5, "citations": [1]}}')
    write("cites.jsonl", f'{good}\n\n{{"answer_text": "x", "citations": []}}\n{{"answer_text": ""}}')
    write("pay.jsonl", '{"question": "q", "answer_record": {"answer_text": "t"}}')
    write("pay2.jsonl", '{"question": "q", "answer_record": {"answer_text": "t"}}\n{"question": "q", "answer_record": [1]}')
    write("pay3.jsonl", '{"question": "q", "answer_record": {"answer_text": null}}')
    write("r.md", "# report")
    write("e.md", " \n\t")
    write("m.csv", 'a,b\n"x\ny",\n,\n')
    write("m2.csv", "a,\n1,2\n")
    write("m3.csv", "a,b\n")
    write("m.json", json.dumps({"run_id": "r", "summary": {}, "rows": [{}, {"x": 1}]}))
    for k, x in enumerate(["", "[1]", '{"run_id": 1, "rows": []}', '{"run_id": 1, "summary": 1, "rows": []}', '{"run_id": 1, "summary": {}, "rows": {}}', '{"run_id": 1, "summary": {}, "rows": []}', '{"run_id": 1, "summary": {}, "rows": [{}, 3]}', "{"]):
        write(f"m{k}.json", x)
    spark.createDataFrame([(good,)] * 5, "value string").repartition(2).write.text(str(tmp_path / "parts.jsonl"))
    cases = [
        ("in dir", "directory", "valid", "Found required directory."), ("in dir", "pdfs", "valid", "Found 1 PDF file(s) for demo ingestion."), ("none", "pdfs", "invalid", "No PDF files"), ("gone", "pdfs", "missing", "Missing"),
        ("r.md", "directory", "invalid", "not a directory"), ("none", "file", "invalid", "not a file: none"), ("r.md", "file", "valid", "Found required file: r.md."), ("gone", "answers", "missing", "Missing required file: gone."),
        ("ok.jsonl", "answers", "valid", "Validated 2 answer row(s) with required fields."), ("blank.jsonl", "answers", "invalid", "File is empty."), ("json.jsonl", "answers", "invalid", "Invalid JSON on line 3."),
        ("list.jsonl", "answers", "invalid", "Row 2 is not a JSON object."), ("text.jsonl", "answers", "invalid", "Row 2 is missing non-empty `answer_text`."), ("cites.jsonl", "answers", "invalid", "Row 2 is missing non-empty `citations`."),
        ("parts.jsonl", "answers", "valid", "Validated 5 answer"), ("pay.jsonl", "payloads", "valid", "Validated 1 demo"), ("pay2.jsonl", "payloads", "invalid", "Row 2 is missing object `answer_record`."), ("pay3.jsonl", "payloads", "invalid", "Row 1 is missing non-empty `answer_record.answer_text`."),
        ("r.md", "text", "valid", "Validated non-empty text file: r.md."), ("e.md", "text", "invalid", "File is empty: e.md."), ("m.csv", "csv", "valid", "with 1 row(s)"), ("m2.csv", "csv", "invalid", "header"), ("m3.csv", "csv", "invalid", "no data rows"), ("e.md", "csv", "invalid", "header"),
        ("m.json", "matrix", "valid", "Validated matrix JSON with 2 row(s)."), ("m0.json", "matrix", "invalid", "is empty"), ("m1.json", "matrix", "invalid", "Expected top-level"), ("m2.json", "matrix", "invalid", "key(s): summary."), ("m3.json", "matrix", "invalid", "`summary` must"),
        ("m4.json", "matrix", "invalid", "must be a JSON array"), ("m5.json", "matrix", "invalid", "array is empty"), ("m6.json", "matrix", "invalid", "non-object"), ("m7.json", "matrix", "invalid", "Invalid JSON"),
    ]
    checks = doctor.checked(spark, [doctor.Wanted(f"n{k}", str(tmp_path / c[0]), c[1], "do this") for k, c in enumerate(cases)]).collect()
    for r, (name, kind, status, says) in zip(checks, cases, strict=True):
        assert (r["status"], says in r["message"]) == (status, True), (name, kind, r)
        assert r["hint"] == (None if status == "valid" else "do this")
    counts = doctor.report(spark.createDataFrame(checks, doctor.CHECKS), "run").first()
    assert (counts["status"], counts["missing"], counts["valid"]) == ("error", 2, counts["present"])
    with pytest.raises(ValueError):
        doctor.checked(spark, [doctor.Wanted("x", "y", "other")])
