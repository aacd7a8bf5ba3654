from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import chunking


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]



def test_tokens_and_similarities(spark):
    assert one(spark, lambda v: t.token_set(v), "Iechä a-b A 12") == ["iech", "a", "b", "12"]
    assert one(spark, lambda v: t.jaccard(t.token_set(v), t.token_set(F.lit("b c"))), "a b") == 1 / 3
    assert one(spark, lambda v: t.jaccard(t.token_set(v), t.token_set(F.lit("!"))), "?") == 0.0
    assert one(spark, lambda v: t.containment(t.token_set(v), t.token_set(F.lit("a b"))), "a b c d") == 0.5


def test_sentences(spark):
    assert one(spark, lambda v: t.sentences(v), " A b.  C d? E\n f ") == ["A b.", "C d?", "E f"]
    assert one(spark, lambda v: t.raw_sentences(v), "") == []
    assert one(spark, lambda v: t.ended(v), "a b ") == "a b." and one(spark, lambda v: t.ended(v), "a!") == "a!"


def test_names_and_ids(spark):
    assert one(spark, lambda v: t.canonical_name(v), " Scope--Change  Plan ") == "scope change plan"
    assert one(spark, lambda v: t.slug(v), "--Hash Base/2--") == "hash_base_2" and one(spark, lambda v: t.slug(v), "--") == "unknown"
    assert one(spark, lambda v: t.excerpt(v, 2), "a b c") == "a b." and one(spark, lambda v: t.excerpt(v, 2), "..") == ""
    assert one(spark, lambda v: t.snippet(v), "x" * 300) == "x" * 277 + "..."


def test_boilerplate(spark):
    for line, expected in [("Page 7 of 742", True), ("A", True), ("42", True), ("3rd Edition", True), ("An ordinary sentence about scope.", False)]:
        assert one(spark, lambda v: t.is_boilerplate(v), line) is expected
    assert one(spark, lambda v: t.page_text(v), "12\n\nPage 1 of 2") == t.EMPTY_PAGE


def test_sections_and_references(spark):
    assert one(spark, lambda v: t.section_of(v), "\nSection 4: Scope -\nx") == "Scope"
    assert one(spark, lambda v: t.section_of(v), "") == "Section"
    assert one(spark, lambda v: t.cross_references(v), "Table 2.1, section 3, Section 3, Figure 2.1") == ["Section 3", "Section 2.1"]


def test_numbers(spark):
    assert [one(spark, lambda v: t.roman_or_arabic(v), x) for x in ["xiv", "12", "0", "abc", "IX"]] == [14, 12, 0, None, 9]
    assert one(spark, lambda v: t.judge_score(v), "Score: 8.5\nReasoning: fine") == 8.5 and one(spark, lambda v: t.judge_score(v), "none") == 5.0
    assert one(spark, lambda v: t.judge_reason(v), "Score: 8.5\nReasoning: fine") == "fine"
    assert [one(spark, lambda v: t.flag(v), x) for x in ["Yes", " off ", "maybe"]] == [True, False, None]


def test_windows(spark):
    parts = one(spark, lambda v: chunking.windows(t.words(v), 6, 2), " ".join(map(str, range(10))))
    assert [len(p.split()) for p in parts] == [6, 6, 2]
    assert one(spark, lambda v: chunking.windows(t.words(v), 6, 2), " ") == [chunking.EMPTY]
    assert len(one(spark, lambda v: chunking.windows(t.words(v), 3, 5), "a b c d")) == 4
    assert [len(p.split()) for p in one(spark, lambda v: chunking.markdown_windows(v, 6, 2), " ".join(map(str, range(10))))] == [6, 6]


def test_headings_and_folds(spark):
    assert one(spark, lambda v: chunking.heading_blocks(v), "intro line here\nScope Plan\nmore text") == ["intro line here", "Scope Plan more text"]
    assert one(spark, lambda v: chunking.sentence_windows(v, 2), "A. B. C.") == ["A. B.", "C."]
    assert one(spark, lambda v: chunking.semantic_chunks(v, 100, 0.2), "a b c. a b d. x y z. q r s.") == ["a b c. a b d. x y z.", "q r s."]


def test_chunk_ids_of_all_strategies(spark):
    pages = spark.createDataFrame([("d1", 1, "S", "One. Two. Three."), ("d1", 2, "S", "")], "doc_id string, page int, section string, text string")
    for strategy in chunking.STRATEGIES:
        rows = chunking.chunk_pages(pages, strategy).collect()
        assert rows and len({r["chunk_id"] for r in rows}) == len(rows) and all(r["chunk_text"] for r in rows)
        assert chunking.strategy_of(chunking.chunk_pages(pages, strategy)) == strategy
