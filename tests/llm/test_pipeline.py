import re

import corpus_pipeline

from lodestone.llm import bpe


def test_stages_take_effect(spark, docs, empty, tmp_path):
    more = docs.selectExpr("*", "1 AS size", "'x' AS kept", "2 AS n_lines")
    at, seen = more, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == more.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in at.collect()})
    quality, lines, groups, mix = seen
    assert all(len(re.findall(r"\S+", r["text"])) >= 20 for r in quality.values())
    assert set(groups) <= set(lines) <= set(quality) and set(mix) <= set(groups)
    assert all(r["size"] == 1 and r["kept"] == "x" and r["n_lines"] == 2 for s in seen for r in s.values())
    assert all(r["n_chars"] == len(r["text"]) for k, r in lines.items() if r["text"] != quality[k]["text"])
    assert not set(range(100, 106)) & set(groups)  # exact copies went with their lines
    final = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert len(final) == at.count()
    coder = bpe.Coder(bpe.default_vocabulary())
    want = {d: len(i) // 4 for d, (i, _) in zip(mix, coder.coded([r["text"] for r in mix.values()]), strict=True)}
    assert all(r["n_tokens"] == len(r["ids"]) == want[r["doc_id"]] for r in final)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_over_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
