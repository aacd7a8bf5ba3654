"""Chunking: pages (doc_id, page, section, text) to chunks (…, chunk_id, chunk_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, cross_references, jaccard, line_list, sentences, stripped, token_set, words

STRATEGIES = ("fixed", "heading_recursive", "sentence_window", "semantic_breakpoint")
EMPTY = "(empty)"


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of words. One starts at every step below the number of words, so the last may lie in the one before."""
    step = max(1, size - overlap)
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    return bound(tokens, lambda w: F.when(F.size(w) == 0, F.array(F.lit(EMPTY))).otherwise(every(w)))


def is_heading(line: Column) -> Column:
    """Not blank, at most 90 characters, and marked with # or title-cased with at most eight words.

    A line without cased letters, such as a number or a Japanese one, counts as title-cased.
    """
    s = stripped(line)
    title = ~s.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]\p{Lu}")
    return (s != "") & (F.length(s) <= 90) & (s.startswith("#") | (title & (F.size(F.split(s, r"(?U)\s+")) <= 8)))


def heading_blocks(text: Column) -> Column:
    """The text cut before each heading: each block's lines stripped and joined by blanks; a text without a line is one
    block as it is.

    Where blocks begin is found first; then each is joined once from its stretch of lines.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(line_list(whole), stripped), lambda x: x != "")

    def cut(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda x, k: F.when(is_heading(x) | (k == 0), k)), lambda k: k.isNotNull())
        end = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(rows))
        return bound(starts, lambda at: F.transform(at, lambda first, j: F.array_join(F.slice(rows, first + 1, end(at, j) - first), " ")))

    return bound(lines, lambda rows: F.when(F.size(rows) == 0, F.array(whole)).otherwise(cut(rows)))


def sentence_windows(text: Column, size: int) -> Column:
    """Groups of `size` sentences, one after the other."""
    every = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(max(1, size))), lambda k: F.array_join(F.slice(s, k + 1, max(1, size)), " "))
    return bound(sentences(text), lambda s: F.when(F.element_at(s, 1) == "", F.array(F.lit(EMPTY))).otherwise(every(s)))


def semantic_chunks(text: Column, size: int, breakpoint: float) -> Column:
    """A fold over sentences: each is appended, then the chunk is closed if it has `size` words or its last two
    sentences are less alike than `breakpoint`. After closing, the next sentence is compared with none.

    The fold carries numbers only: where chunks start, and the words of the open one. The texts are cut out once after it.
    """
    state = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def add(at: Column, x: Column) -> Column:
        n = F.when(at["closed"], x["n"]).otherwise(at["n"] + x["n"])
        close = (~at["closed"] & (x["alike"] < breakpoint)) | (n >= size)
        return F.struct(F.when(at["closed"], F.concat(at["starts"], F.array(x["k"]))).otherwise(at["starts"]).alias("starts"), n.alias("n"), close.alias("closed"))

    def cut(s: Column) -> Column:
        marks = bound(
            F.transform(s, lambda x: token_set(x)),
            lambda t: F.transform(
                s,
                lambda x, k: F.struct(k.alias("k"), F.size(words(x)).alias("n"), F.when(k == 0, 1.0).otherwise(jaccard(F.get(t, k - 1), F.get(t, k))).alias("alike")),
            ),
        )
        starts = F.aggregate(marks, state, add, lambda at: at["starts"])
        end = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(s))
        return bound(starts, lambda at: F.transform(at, lambda first, j: F.array_join(F.slice(s, first + 1, end(at, j) - first), " ")))

    return bound(sentences(text), lambda s: F.when(F.element_at(s, 1) == "", F.array(F.lit(EMPTY))).otherwise(cut(s)))


def markdown_windows(text: Column, size: int, overlap: int) -> Column:
    """The text itself if it has at most `size` words, else windows without a redundant last one."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    every = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - overlap - 1), F.lit(size - overlap)), lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    return bound(words(text), lambda w: F.when(F.size(w) <= size, F.array(text)).otherwise(every(w)))


def markdown_chunks(sections: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """Sections (doc_id, section_no, level, path, content) to (doc_id, chunk_id, section_path, section_level, chunk_text).

    A section of at most `size` words is one chunk as it is, a longer one is cut into windows; sections without a word
    have none. chunk_id is chunk_<number>, of at least six digits: chunks are numbered from 0 through each document, in
    its order. Only the counts of a document's sections stand in its window, not their texts.
    """
    parts = sections.where(F.size(words(F.col("content"))) > 0).withColumn("__parts", markdown_windows(F.col("content"), size, overlap))
    order = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("doc_id", "section_no", F.size("__parts").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    cut = parts.join(before, ["doc_id", "section_no"]).select("doc_id", "path", "level", "__before", F.posexplode("__parts").alias("__k", "chunk_text"))
    number = (F.col("__before") + F.col("__k")).cast("string")
    name = F.concat(F.lit("chunk_"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")))
    return cut.select("doc_id", name.alias("chunk_id"), F.col("path").alias("section_path"), F.col("level").alias("section_level"), "chunk_text")


def chunk_pages(pages: DataFrame, strategy: str = "heading_recursive", size: int = 512, overlap: int = 50, window: int = 3, breakpoint: float = 0.2) -> DataFrame:
    """Adds chunk_no (from 1 in each page row), chunk_id and chunk_text; text goes."""
    text = F.col("text")
    if strategy == "fixed":
        parts = windows(words(text), size, overlap)
    elif strategy == "heading_recursive":
        parts = F.flatten(F.transform(heading_blocks(text), lambda b: windows(words(b), size, overlap)))
    elif strategy == "sentence_window":
        parts = sentence_windows(text, window)
    elif strategy == "semantic_breakpoint":
        parts = semantic_chunks(text, size, breakpoint)
    else:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    keep = [c for c in pages.columns if c != "text"]
    out = pages.select(*keep, F.posexplode(parts).alias("chunk_no", "chunk_text")).withColumn("chunk_no", F.col("chunk_no") + 1)
    return out.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("-p"), F.col("page").cast("string"), F.lit(f"-{strategy}-c"), F.col("chunk_no").cast("string")))


def enriched(chunks: DataFrame, section_path: Column | None = None) -> DataFrame:
    """Adds chunk_type (table where the text says so), section_path and cross_refs."""
    return chunks.withColumns(
        {
            "chunk_type": F.when(F.col("chunk_text").contains("TABLE:"), "table").otherwise("text"),
            "section_path": section_path if section_path is not None else F.concat(F.lit("Page "), F.col("page").cast("string")),
            "cross_refs": cross_references(F.col("chunk_text")),
        }
    )


def strategy_of(chunks: DataFrame) -> str:
    """The strategy that the first chunk's id names."""
    row = chunks.agg(F.min("chunk_id")).first()[0]
    return next((s for s in STRATEGIES if row and s in row), "heading_recursive")
