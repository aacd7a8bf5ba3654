"""Whole jobs: ingest, index, graph and answers, composed of the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_text, section_of, snippet
from ..sources.files import documents
from ..sources.shared import fixed
from . import answer, chunking, cleaning, evaluate, graph, retrieval, store, vectors

REPEATED = 0.7
GUIDED = "pmbok"
#: Names of the built-in hashed embedding; anything else is a model of the caller's.
HASHED = store.HASHED_PROVIDERS


class Ingested(NamedTuple):
    documents: DataFrame
    pages: DataFrame
    chunks: DataFrame


def cleaned_pages(raw: DataFrame, threshold: float = REPEATED) -> DataFrame:
    """(doc_id, page, text): lines stripped, without boilerplate and lines that repeat over a document's pages."""
    return cleaning.without_repeated_lines(raw.select("doc_id", "page", page_text(F.col("text")).alias("text")), threshold=threshold)


def sectioned_pages(raw: DataFrame, guided: DataFrame | None = None, threshold: float = REPEATED) -> DataFrame:
    """(doc_id, page, section, text, path) of raw pages (doc_id, page, text, parsed), and one more row for each table of a
    parsed page, its text "TABLE:" and the table.

    `guided` are raw pages of documents whose contents name their sections; path is null for all others. A page that the
    contents don't cover is named by its first line.
    """
    tables = cleaning.page_tables(raw.where("parsed")).select("doc_id", "page", F.concat(F.lit("TABLE:\n"), "markdown").alias("text"), F.lit("Section").alias("own"))
    text = cleaned_pages(raw, threshold)
    rows = text.withColumn("own", F.when(F.col("text") == "(empty page)", "Section").otherwise(section_of(F.col("text")))).unionByName(tables)
    if guided is None:
        return rows.select("doc_id", "page", F.col("own").alias("section"), "text", F.lit(None).cast("string").alias("path"))
    rows = rows.join(vectors.broadcast_if_small(fixed(cleaning.contents(guided))), ["doc_id", "page"], "left")
    return rows.select("doc_id", "page", F.coalesce("path", "own").alias("section"), "text", "path")


def ingested(found: DataFrame, raw: DataFrame, strategy: str = "heading_recursive", **sizes) -> Ingested:
    """Documents, pages and chunks of files (files.files; their contents aren't read) and their raw pages (files.raw_pages,
    written once, as several steps read them). Chunks of a table have the ids of its page's first chunks, as they are
    numbered by row."""
    of_kind = vectors.broadcast_if_small(fixed(found.where(F.col("document_type") == GUIDED).select("doc_id").distinct()))
    guided = raw.join(of_kind, "doc_id", "left_semi")
    pages = fixed(sectioned_pages(raw, guided))  # all three tables are made of them
    chunks = chunking.chunk_pages(pages, strategy, **sizes).join(of_kind.withColumn("__guided", F.lit(True)), "doc_id", "left")
    path = F.when(F.col("__guided"), F.coalesce("path", F.concat(F.lit("Page "), F.col("page").cast("string")))).otherwise("")
    named = documents(found, pages.where(~F.col("text").startswith("TABLE:")))
    return Ingested(named, pages.drop("path"), chunking.enriched(chunks, path).drop("path", "__guided"))


def provider_of(name: str) -> str:
    """The provider that a setting names: the built-in one, or a served model."""
    name = name.strip().lower() or "local_hash"
    if name not in (*HASHED, "ollama"):
        raise ValueError(f"unknown embedding provider: {name}")
    return "local_hash" if name in HASHED else name


def index(chunks: DataFrame, model: str = "hash", dimensions: int = vectors.DIMENSIONS) -> DataFrame:
    """(row_idx, chunk_id, embedding, provider, embedding_model, dim) of every chunk, numbered in their order."""
    if dimensions < 1:
        raise ValueError("dimensions must be positive")
    rows = vectors.embedded(chunks.select("chunk_id", "doc_id", "page", "section", "chunk_text"), "chunk_text", dimensions, dense=True)
    rows = evaluate.numbered(rows)  # vectors move to their places, not texts
    return rows.select(F.col("at").alias("row_idx"), "chunk_id", "embedding", F.lit("local_hash").alias("provider"), F.lit(model).alias("embedding_model"), F.lit(dimensions).alias("dim"))


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame


def graph_of(chunks: DataFrame) -> Graph:
    """Nodes, edges and mentions of the chunks' relations, which are found once."""
    found = evaluate.fixed(graph.triples(chunks))
    return Graph(evaluate.fixed(graph.nodes(found)), evaluate.fixed(graph.edges(found)), graph.mentions(found))


def smoke_answers(questions: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """(question_id, chunk_id, excerpt): the best chunk of each question by shared tokens."""
    best = retrieval.lexical_search(questions, chunks, k).where("rank = 1").select("question_id", "chunk_id")
    best = vectors.broadcast_if_small(fixed(best))  # a row for each question
    return best.join(chunks, "chunk_id").select("question_id", "chunk_id", snippet(F.col("chunk_text")).alias("excerpt"))


def smoke(questions: DataFrame, raw: DataFrame, k: int = 8, size: int = 512, overlap: int = 50) -> DataFrame:
    """Raw pages (doc_id, page, text, parsed) to (question_id, answer_text, chunk_id, doc_id, page, section): pages are
    cleaned and cut into fixed chunks, once for all steps, and the best of each question's k is its answer and only citation."""
    chunks = fixed(chunking.chunk_pages(sectioned_pages(raw).drop("path"), "fixed", size=size, overlap=overlap))
    best = vectors.broadcast_if_small(fixed(smoke_answers(questions, chunks, k)))
    out = best.join(chunks.select("chunk_id", "doc_id", "page", "section"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    said = F.concat(F.lit("For '"), "question", F.lit("', the source states: "), "excerpt")
    return out.select("question_id", said.alias("answer_text"), "chunk_id", "doc_id", "page", "section")


def retrieved(questions: DataFrame, chunks: DataFrame, mode: str, k: int, built: Graph | None = None) -> DataFrame:
    """(question_id, rank, chunk_id, score, vector_score, graph_score) by vector, graph or hybrid search.

    Hybrid search answers by vectors alone where the graph finds nothing, or there is none.
    """
    if mode not in ("vector", "graph", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    columns = ["question_id", "rank", "chunk_id", "score", "vector_score", "graph_score"]
    if mode == "graph" and built is None:
        raise ValueError("graph search needs a graph")
    walked = None if mode == "vector" or built is None else graph.graph_search(questions, built.nodes, built.edges, k, chunks=chunks)
    if mode == "graph":
        return retrieval.widened(walked, "graph").select(*columns)
    near = vectors.sparse_search(questions, chunks, k)
    alone = retrieval.widened(near, "vector").select(*columns)
    if walked is None:
        return alone
    some = walked.select("question_id").distinct()
    both = retrieval.fused(near.join(some, "question_id", "left_semi"), walked, k)
    return both.select(*columns).unionByName(alone.join(some, "question_id", "left_anti"))


def vector_query(questions: DataFrame, chunks: DataFrame, embeddings: DataFrame, k: int, provider: str = "local_hash", model: str = "hash", dimensions: int = vectors.DIMENSIONS) -> DataFrame:
    """(question_id, rank, score, chunk_id, doc_id, page, section): the k chunks nearest to each question by the stored
    vectors, ties to the smaller row_idx. k below 1 counts as 1.

    The index is held against its chunks and the settings in the query's own plan: where its metadata mix providers,
    models or dimensions, its rows are misnumbered or name unknown chunks, or the settings name another provider, model
    or dimension, the query fails with what is wrong.
    """
    if provider_of(provider) != "local_hash":
        raise ValueError(f"questions of provider {provider} are embedded by its model: search their vectors")
    asked = store.guarded(questions.select("question_id", "question"), store.index_problem(embeddings, chunks, provider_of(provider), model, dimensions))
    asked = asked.select("question_id", vectors.dense_embedding(F.col("question"), dimensions).alias("query"))
    rows = store.aligned(embeddings.select("row_idx", "chunk_id", "embedding"), chunks.select("chunk_id", "doc_id", "page", "section"))
    hits = vectors.cosine_search(asked, rows.select("row_idx", "embedding"), k)
    return hits.join(rows.drop("embedding"), "row_idx").select("question_id", "rank", "score", "chunk_id", "doc_id", "page", "section")


def answered(questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = 8, built: Graph | None = None, replies: DataFrame | None = None, candidates: int = 30, max_sentences: int = 3) -> DataFrame:
    """(question_id, answer_text, citations): grounded answers. With a model's replies (question_id, raw), of which each
    ranks its question's candidates anew, the first k of that order count. A question without hits says so."""
    hits = retrieved(questions, chunks, mode, k if replies is None else max(k, candidates), built)
    if replies is not None:
        hits = retrieval.truncated(retrieval.reranked(hits, replies), k)
    said = answer.answers(answer.traced(hits, chunks, max_sentences))
    out = questions.select("question_id").join(said, "question_id", "left")
    return out.withColumns({"answer_text": F.coalesce("answer_text", F.lit(answer.NOTHING)), "citations": F.coalesce("citations", F.array().cast("array<string>"))})
