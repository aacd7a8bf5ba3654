from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import chunking, cleaning


def test_lines_end_in_any_way(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("Intro\r\n12\r\n\tPMI.\t\r\nbody", t.page_text) == "Intro\nbody"
    assert one("a1\rb2\x0bc3\x0cd4\x85e5 f6\x1cg7", t.page_text) == "a1\nb2\nc3\nd4\ne5\nf6\ng7"
    assert one("\xa0　Page 7 of 742 \r\n x", t.page_text) == "(empty page)"
    assert one("\t\r\n  Section 12: Costs\r\nmore", t.section_of) == "Costs" and one("\tTitle\r\nrest", t.first_line) == "Title"
    assert one("Scope\r\nplain text here\r\n# Risk\r\nmore", chunking.heading_blocks) == ["Scope plain text here", "# Risk more"]
    assert one("lower case\nand more of it", chunking.heading_blocks) == ["lower case and more of it"] and one(" \r\n\t", chunking.heading_blocks) == [" \r\n\t"]


def test_running_heads_with_unlike_ends(spark):
    pages = spark.createDataFrame([("d", k, f"\tHead{end}text {k}{end}Foot\t") for k, end in enumerate(["\n", "\r\n", "\r", "\r\n"], 1)], "doc_id string, page int, text string")
    assert {(r["page"], r["text"]) for r in cleaning.without_repeated_lines(pages).collect()} == {(k, f"text {k}") for k in range(1, 5)}


def test_paths_of_very_many_headings(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), F.when(F.col("id") % 1000 == 0, 1).when(F.col("id") % 10 == 0, 3).otherwise(4).alias("level"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    got = {r["pos"]: r["path"] for r in cleaning.contents_paths(rows).collect()}
    for k in (0, 1, 999, 1000, 54321, n - 1):
        want = [f"t{k // 1000 * 1000}"] + ([f"t{k // 10 * 10}"] if k % 1000 >= 10 else []) + ([f"t{k}"] if k % 10 else [])
        assert got[k] == " / ".join(want)


def test_paths_by_levels(spark):
    import random

    rng = random.Random(3)
    levels = [rng.choice([1, 2, 2, 3, 5, 7]) for _ in range(200)]
    rows = spark.createDataFrame([("d", 1, k, x, f"t{k}") for k, x in enumerate(levels)], "doc_id string, page int, pos int, level int, title string")
    stack, want = [], {}
    for k, x in enumerate(levels):
        while stack and stack[-1][0] >= x:
            stack.pop()
        stack.append((x, f"t{k}"))
        want[k] = " / ".join(title for _, title in stack)
    assert {r["pos"]: r["path"] for r in cleaning.contents_paths(rows).collect()} == want
    assert cleaning.contents_paths(rows.where("false")).count() == 0
