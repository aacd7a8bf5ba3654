"""Evaluation: metrics of rankings and answers, question generation, factorial experiments, comparisons."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.statistics import t_test_p_value
from ..functions.text import FALSE_WORDS, TRUE_WORDS, bound, excerpt, jaccard, section_name, slug, squeezed, token_set, value_scale
from ..sources.files import json_lines
from ..sources.shared import fixed
from .retrieval import Tokens, fused, token_counting
from .vectors import broadcast_if_small, in_blocks, top_k

# Fixed values.
TEMPLATES = {
    "fact": [
        "What does {doc_id} page {page} describe in the '{section}' section?",
        "According to '{section}' in {doc_id}, what is the key point?",
        "Which detail is stated in {doc_id} p{page} under '{section}'?",
    ],
    "multi_hop": [
        "How does '{section_a}' in {doc_a} connect to '{section_b}' in {doc_b}?",
        "What relationship links {doc_a} p{page_a} '{section_a}' with {doc_b} p{page_b} '{section_b}'?",
        "Using both '{section_a}' and '{section_b}', what combined conclusion is supported?",
    ],
    "contrast": [
        "Contrast '{section_a}' from {doc_a} with '{section_b}' from {doc_b}.",
        "How does {doc_a} p{page_a} '{section_a}' differ from {doc_b} p{page_b} '{section_b}'?",
        "What is the main contrast between '{section_a}' and '{section_b}'?",
    ],
}
TYPE_MIX = {"fact": 0.45, "multi_hop": 0.35, "contrast": 0.20}
DEFAULT_PROVIDER = "local"


def deduplicated(hits: DataFrame, k: int) -> DataFrame:
    """Of the hits ranked up to k the first of each chunk, with their position among these."""
    w = Window.partitionBy("question_id", "chunk_id").orderBy("rank")
    first = hits.where(F.col("rank") <= k).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def _every(questions: DataFrame, rows: DataFrame, *metrics: str) -> DataFrame:
    return questions.select("question_id").distinct().join(rows, "question_id", "left").fillna(0.0, list(metrics))


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int, questions: DataFrame | None = None) -> DataFrame:
    """(question_id, recall, ndcg) at k for every question with gold (question_id, chunk_id).

    Given the questions, those without gold count too, with 0.
    """
    gold = gold.select("question_id", "chunk_id").distinct()
    size = gold.groupBy("question_id").agg(F.count("*").alias("gold"))
    found = deduplicated(hits, k).join(gold, ["question_id", "chunk_id"])
    gain = found.groupBy("question_id").agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col("position") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", F.lit(k)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1.0))
    out = size.join(gain, "question_id", "left").fillna({"found": 0, "dcg": 0.0})
    out = out.select("question_id", (F.col("found") / F.col("gold")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"))
    return out if questions is None else _every(questions, out, "recall", "ndcg")


def citation_precision(cited: DataFrame, gold: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(question_id, precision): share of a question's distinct cited chunks that are gold.

    Given the questions, those without citations count too, with 0.
    """
    cited = cited.select("question_id", "chunk_id").distinct()
    hit = cited.join(gold.select("question_id", "chunk_id").distinct().withColumn("good", F.lit(1)), ["question_id", "chunk_id"], "left")
    out = hit.groupBy("question_id").agg((F.count("good") / F.count("*")).alias("precision"))
    return out if questions is None else _every(questions, out, "precision")


def faithfulness(answers: DataFrame, trace: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, faithfulness): share of an answer's tokens that its cited chunks have."""
    said = answers.select("question_id", F.explode(token_set(F.col("answer_text"))).alias("token"))
    cited = broadcast_if_small(fixed(trace.select("question_id", "chunk_id").distinct())).join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
    known = cited.select("question_id", F.explode(token_set(F.col("chunk_text"))).alias("token")).distinct().withColumn("known", F.lit(1))
    rate = said.join(known, ["question_id", "token"], "left").groupBy("question_id").agg((F.count("known") / F.count("*")).alias("faithfulness"))
    return answers.select("question_id").join(rate, "question_id", "left").fillna(0.0, ["faithfulness"])


#: Words in a row by which texts that hold an item are looked up.
KEY_WORDS = 3
#: Pairs of texts and items with an equal key that are broadcast after being counted.
MOST_MET = 20_000


def holding(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(chunk_id, chunk_text) and (question_id, question) to (question_id, chunk_id) of the chunks that hold a question's
    whole text, as it is.

    Where a text stands within another, all its words between white space but the first and the last are words of the
    other. So the first KEY_WORDS of these are a key: chunks and items meet by an equal key, and only then is the text
    looked for. Items with too few words have none; they are looked for in every chunk.
    """
    spaced = lambda text: F.split(text, r"(?U)\s+")
    keyed = items.select("question_id", "question", spaced(F.col("question")).alias("w"))
    long = keyed.where(F.size("w") >= KEY_WORDS + 2).select("question_id", "question", F.xxhash64(F.slice("w", 2, KEY_WORDS)).alias("key"))
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - KEY_WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, KEY_WORDS))))
    keys = chunks.select("chunk_id", F.explode(bound(spaced(F.col("chunk_text")), runs)).alias("key"))
    # few chunks meet an item, so that these are sent to the texts, and texts aren't shuffled
    met = fixed(keys.join(long.select("key", "question_id", "question"), "key").select("chunk_id", "question_id", "question").distinct())
    found = broadcast_if_small(met, MOST_MET).join(chunks.select("chunk_id", "chunk_text"), "chunk_id").where(F.col("chunk_text").contains(F.col("question"))).select("question_id", "chunk_id")
    short = keyed.where(F.size("w") < KEY_WORDS + 2).select("question_id", "question")
    return found.unionByName(chunks.join(short, F.col("chunk_text").contains(F.col("question"))).select("question_id", "chunk_id")).distinct()


def query_metrics(questions: DataFrame, hits: DataFrame, gold: DataFrame, trace: DataFrame, answers: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, recall, ndcg, precision, faithfulness) of every question, 0 where it has no gold, citation or answer."""
    ranked = ranking_metrics(hits, gold, k, questions)
    cited = citation_precision(trace, gold, questions)
    said = _every(questions, faithfulness(answers, trace, chunks), "faithfulness")
    return ranked.join(cited, "question_id").join(said, "question_id")


def judge_means(judgements: DataFrame) -> DataFrame:
    """(question_id, criterion, score) to (question_id, avg_score), the mean of a question's scores; a missing score is 0."""
    return judgements.groupBy("question_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"))


def averaged(rows: DataFrame, *metrics: str) -> DataFrame:
    """One row with each metric's mean, 0 without rows."""
    return rows.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def type_targets(spark: SparkSession, size: int, mix: dict[str, float] | None = None) -> DataFrame:
    """(type, n): the size shared by the mix, by largest remainder, ties in the mix's order."""
    mix = TYPE_MIX if mix is None else mix
    if size < 1 or any(w < 0 for w in mix.values()) or sum(mix.values()) <= 0:
        raise ValueError("size must be positive and weights not negative with a positive sum")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("type"), F.lit(float(w)).alias("w")) for k, (t, w) in enumerate(mix.items())])
    df = spark.range(1).select(F.inline(rows))
    share = F.col("w") / F.lit(float(sum(mix.values()))) * size
    df = df.withColumn("share", share).withColumn("n", F.floor("share").cast("int"))
    rest = F.lit(size) - F.sum("n").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("n")), "k"))
    return df.withColumn("rest", rest).withColumn("place", place).select("type", (F.col("n") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0)).alias("n"))


def pair_index(idx: Column, count: Column, stride: int) -> Column:
    """The second chunk of a pair whose first is idx modulo count; with one chunk, the same."""
    offset = F.pmod(F.floor(idx / count), F.greatest(count - 1, F.lit(1))) + 1
    return F.when(count == 1, F.lit(0)).otherwise(F.pmod(idx + offset * stride, count))


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with their place, from 0, in the order of doc_id, page, section, chunk_id.

    Ranges of the order are sorted, numbered apart and shifted by the counts before them, so no task holds all chunks, and
    each moves once.
    """
    order = ["doc_id", "page", "section", "chunk_id"]
    parts = fixed(chunks.repartitionByRange(*order).sortWithinPartitions(*order))
    parts = parts.withColumns({"__p": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    before = parts.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("__id") - F.shiftleft(F.col("__p").cast("long"), 33)  # ids of a partition rise by one from there
    return parts.withColumn("at", local).join(F.broadcast(before.drop("__c")), "__p").withColumn("at", F.col("at") + F.col("__b")).drop("__p", "__b", "__id")


def question_pairs(spark: SparkSession, chunks: DataFrame, kind: str, n: int, places: DataFrame | None = None) -> DataFrame:
    """(idx, type, first_chunk, second_chunk, gold_answer) of n drafts of a kind; facts have no second chunk. `places` are
    the numbered chunks, if the caller has them."""
    places = numbered(chunks) if places is None else places
    count = F.lit(places.count())
    draft = spark.range(n).select(F.col("id").alias("idx"), F.pmod("id", count).alias("one"), pair_index(F.col("id"), count, 2 if kind == "contrast" else 1).alias("two"))
    one = places.select(F.col("at").alias("one"), F.col("chunk_id").alias("first_chunk"), F.col("doc_id").alias("d1"), F.col("page").alias("p1"), F.col("chunk_text").alias("t1"), section_name(F.col("section")).alias("s1"))
    two = places.select(F.col("at").alias("two"), F.col("chunk_id").alias("second_chunk"), F.col("doc_id").alias("d2"), F.col("page").alias("p2"), F.col("chunk_text").alias("t2"), section_name(F.col("section")).alias("s2"))
    rows = draft.join(one, "one").join(two, "two")
    if kind == "fact":
        rows, answer = rows.withColumn("second_chunk", F.lit(None).cast("string")), excerpt(F.col("t1"), 22)
    elif kind == "multi_hop":
        answer = F.trim(F.concat(excerpt(F.col("t1"), 12), F.lit(" "), excerpt(F.col("t2"), 12)))
    else:
        answer = F.trim(F.concat(F.col("s1"), F.lit(" focuses on "), excerpt(F.col("t1"), 10), F.lit(" while "), F.col("s2"), F.lit(" emphasizes "), excerpt(F.col("t2"), 10)))
    named = {"doc_id": "d1", "page": "p1", "section": "s1", "doc_a": "d1", "page_a": "p1", "section_a": "s1", "doc_b": "d2", "page_b": "p2", "section_b": "s2"}
    fill = lambda template: F.concat(*[F.col(named[x[1:-1]]).cast("string") if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", template)])
    question = F.get(F.array(*[fill(x) for x in TEMPLATES[kind]]), (F.col("idx") % 3).cast("int"))
    return rows.select("idx", F.lit(kind).alias("type"), question.alias("question"), "first_chunk", "second_chunk", answer.alias("gold_answer"))


#: Numbers that the drafts of one question start from, at most, for their places to be counted at once.
MOST_STARTS = 256


def first_free(jobs: DataFrame) -> DataFrame:
    """(key, block, start, at, counted, ...) to the same with `free`: the first number from `start` on that the key's
    counted rows before `at` don't take, if each of them takes, in the order of `at`, the first from its own start on.

    Which numbers a set of rows takes doesn't depend on their order, so it is enough to know how many rows before one
    begin at each start. These counts are summed within blocks (of rows that follow each other in `at`) and shifted by
    those of the blocks before, so a task holds a block's rows of a key.
    """
    counts = jobs.groupBy("key", "block", "start").agg(F.count_if("counted")).toDF("its_key", "its_block", "its_start", "n")
    grid = counts.select("its_key", "its_block").distinct().join(counts.select("its_key", "its_start").distinct(), "its_key")
    before = Window.partitionBy("its_key", "its_start").orderBy("its_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grid.join(counts, ["its_key", "its_block", "its_start"], "left").withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))  # of starts and blocks, not of rows

    def placed(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows, before = rows.sort_values("at"), before.sort_values("its_start")
        start, counted = rows["start"].to_numpy(), rows["counted"].to_numpy()
        free = np.full(len(rows), before["its_start"].min())
        for at, n in zip(before["its_start"].to_numpy(), before["n"].to_numpy(), strict=True):
            mine = counted & (start == at)
            taken = n + np.cumsum(mine) - mine
            # who begins below a gap stays there; for all others numbers go on from it, or from where they got to
            free = np.where((start < at) & (free < at), free, np.maximum(free, at) + taken)
        return rows.assign(free=free)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema.fields)
    return jobs.groupBy("key", "block").cogroup(offsets.groupBy("its_key", "its_block")).applyInPandas(placed, f"{schema}, free long")


def numbers_of(drafts: DataFrame) -> DataFrame:
    """(at, number) of those drafts (at, block, key, seed) that get a number; for keys with more than MOST_STARTS starts
    there are none.

    All drafts of a key but the first get a number of it. The first may have a name that another key's drafts ask for
    with a number ("Why? (2)" and "Why?"). Such a name takes part there as a row with one number only: where it isn't
    free, the draft has lost its name and numbers its own key. Those that the others alone make lose are found at once;
    of the rest, the first in order that loses is certain in each key, until none does.
    """
    heads = drafts.groupBy("key").agg(F.min_by(F.struct("at", "block", "seed"), "at").alias("h")).select("key", "h.*")
    number = F.regexp_extract("key", r"^(?s:.*) ?\((0|-?[1-9][0-9]{0,17})\)$", 1)
    named = heads.where(number != "").select("at", "block", F.col("key").alias("own"), F.col("seed"), number.cast("long").alias("start"))
    named = named.withColumn("key", F.rtrim(F.expr("substring(own, 1, length(own) - length(start) - 2)"))).where((F.col("key") == "") | (F.concat("key", F.lit(" ("), F.col("start"), F.lit(")")) == F.col("own")))
    later = drafts.join(heads.select("key", F.col("at").alias("head")), "key").where("at <> head").select("key", "block", (F.col("seed") + 1).alias("start"), "at")
    asked = later.select("key", "start").unionByName(named.select("key", "start")).groupBy("key").agg(F.count_distinct("start").alias("starts"))
    some = later.select("key").distinct().join(asked.where(F.col("starts") <= MOST_STARTS), "key").select("key")
    later = fixed(later.join(some, "key", "left_semi"))
    named = fixed(named.join(some, "key", "left_semi"))
    own = named.select(F.col("own").alias("key"), "block", (F.col("seed") + 1).alias("start"), "at")
    lost, counted = None, False
    while True:
        lists = lambda df, name, count: df.select("key", "block", "start", "at", F.lit(name).alias("name"), F.lit(count).alias("counted"))
        left = named if lost is None else named.join(lost, "at", "left_anti")
        jobs = lists(later, False, True).unionByName(lists(left, True, counted))
        jobs = jobs if lost is None else jobs.unionByName(lists(own.join(lost, "at", "left_semi"), False, True))
        free = fixed(first_free(jobs))
        out = free.where("name AND free <> start")
        out = fixed((out.groupBy("key").agg(F.min("at").alias("at")) if counted else out).select("at"))
        if counted and out.isEmpty():
            return free.where("NOT name").select("at", F.col("free").alias("number"))
        lost, counted = out if lost is None else fixed(lost.unionByName(out)), True


def unique_questions(drafts: DataFrame, order: list[str], question: str = "question", seed: str = "idx") -> DataFrame:
    """Drafts with their question made unique, but for case and white space, as if they came one by one in `order`.

    The first of equal questions stays, stripped. A later one gets a number in brackets, the first from seed + 1 on that
    makes a question none before it has: neither a draft's own nor a numbered one. `order` must be total.

    Numbers are counted first: see `numbers_of`. Then each draft asks for its name, the first in order gets it, and the
    others go on to their next number, until all have different names; after the counting there are others only for
    questions with very many starts. Of those that go on from one number of one question, each later one starts one
    number further, as those before it take that many. A draft leaves a name only for one before it, so what all rounds
    give is what going through the drafts one by one gives. Null questions stay null.
    """
    base = F.regexp_replace(F.col(question), r"(?U)^\s+|\s+$", "")
    same = lambda c: F.lower(squeezed(c))
    rows = drafts.select(*order, F.col(seed).cast("long").alias("__seed"), base.alias("__base")).where(F.col("__base").isNotNull())
    rows = fixed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = rows.withColumns({"__at": F.monotonically_increasing_id(), "__block": F.spark_partition_id()})
    rows = fixed(rows)
    numbers = numbers_of(rows.select(F.col("__at").alias("at"), F.col("__block").alias("block"), same(F.col("__base")).alias("key"), F.col("__seed").alias("seed")))
    now = fixed(rows.join(numbers.select(F.col("at").alias("__at"), F.col("number").alias("__number")), "__at", "left").drop("__block"))
    name = F.when(F.col("__number").isNull(), F.col("__base")).otherwise(F.concat("__base", F.lit(" ("), F.col("__number").cast("string"), F.lit(")")))
    while True:
        asked = now.withColumn("__name", name).withColumn("__place", F.row_number().over(Window.partitionBy(same(F.col("__name"))).orderBy("__at")))
        asked = fixed(asked)
        if asked.where("__place > 1").isEmpty():
            break
        lost, following = F.col("__place") > 1, F.coalesce(F.col("__number") + 1, F.col("__seed") + 1)
        group = Window.partitionBy(same(F.col("__base")), lost, following).orderBy("__at")
        now = asked.withColumn("__number", F.when(lost, following + F.row_number().over(group) - 1).otherwise(F.col("__number"))).drop("__name", "__place")
    return drafts.drop(question).join(asked.select(*order, F.col("__name").alias(question)), order, "left")


def generated_questions(spark: SparkSession, chunks: DataFrame, run: str, size: int) -> DataFrame:
    """(question_id, type, question, first_chunk, second_chunk, gold_answer): `size` questions in the usual mix, each one
    unique: see `unique_questions`."""
    targets = {r["type"]: r["n"] for r in type_targets(spark, size).collect()}  # three rows
    places = numbered(chunks)  # once for all kinds
    parts = [question_pairs(spark, chunks, kind, targets[kind], places).withColumn("__k", F.lit(k)) for k, kind in enumerate(TYPE_MIX)]
    out = unique_questions(fixed(parts[0].unionByName(parts[1]).unionByName(parts[2])), ["__k", "idx"])
    number = F.row_number().over(Window.orderBy("__k", "idx"))  # an evaluation's bounded set
    out = out.withColumn("question_id", F.concat(F.lit(f"{run}:q"), F.lpad(number.cast("string"), 4, "0")))
    return out.select("question_id", "type", "question", "first_chunk", "second_chunk", "gold_answer")


def grid(spark: SparkSession, chunking: list[str], embedding: list[str], retrieval: list[str], providers: list[str] | None = None, rerank: list[bool] | None = None, rerank_models: list[str] | None = None) -> DataFrame:
    """One row for each combination of factors, with its experiment's name."""
    axes = {"chunking": chunking, "embedding": embedding, "retrieval": retrieval, "embedding_provider": providers or [DEFAULT_PROVIDER], "reranker_enabled": rerank or [False], "reranker_model": rerank_models or ["none"]}
    out = spark.range(1).select()
    for axis, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(axis))
    name = F.concat(F.lit("exp_"), slug(F.col("chunking")), F.lit("_"), slug(F.col("embedding")), F.lit("_"), slug(F.col("retrieval")))
    name = F.when(F.lower(F.trim("embedding_provider")) != DEFAULT_PROVIDER, F.concat(name, F.lit("_provider_"), slug(F.col("embedding_provider")))).otherwise(name)
    return out.withColumn("exp_id", F.when(F.col("reranker_enabled"), F.concat(name, F.lit("_reranker_"), slug(F.col("reranker_model")))).otherwise(name))


#: Factors of an experiment: other names that a configuration may use for each, and its values where it names none.
FACTORS = {
    "chunking": ((), ("fixed", "heading_recursive", "sentence_window", "semantic_breakpoint")),
    "embedding_model": (("embedding", "embeddings"), ("hash-small", "hash-base", "hash-large")),
    "retrieval": (("retrieval_modes",), ("vector", "graph", "hybrid")),
    "embedding_provider": ((), (DEFAULT_PROVIDER,)),
    "reranker_enabled": ((), ("false",)),
    "reranker_model": ((), ("none",)),
}


def factor_values(config: dict, name: str) -> list[str]:
    """A factor's values in a configuration: the first list that has any, under its own name or another one, among the
    configuration's `factors`, then its `defaults`, then at its top; else the usual ones. Blank values don't count."""
    others, usual = FACTORS[name]
    for part in (config.get("factors"), config.get("defaults"), config):
        for key in (name, *others) if isinstance(part, dict) else ():
            listed = part.get(key)
            found = [str(v).strip() for v in listed if str(v).strip()] if isinstance(listed, list) else []
            if found:
                return found
    return list(usual)


def grid_of(spark: SparkSession, config: dict) -> DataFrame:
    """The grid that a configuration names, a row for each combination of its factors' values. A value of
    reranker_enabled that is neither true nor false is an error."""
    values = {name: factor_values(config, name) for name in FACTORS}
    flags = [v.strip().lower() for v in values["reranker_enabled"]]
    if wrong := [v for v in flags if v not in TRUE_WORDS + FALSE_WORDS]:
        raise ValueError(f"reranker_enabled is neither true nor false: {wrong[0]}")
    enabled = [v in TRUE_WORDS for v in flags]
    return grid(spark, values["chunking"], values["embedding_model"], values["retrieval"], values["embedding_provider"], enabled, values["reranker_model"])


def questions_of(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, type, question, gold_citations, gold_answer) of a file of JSON lines. A file without questions is an
    error, and so is a row without an id or a question, which fails the query that reads it."""
    rows = json_lines(spark, path, "question_id string, type string, question string, gold_citations array<struct<chunk_id:string,doc_id:string,page:int,section:string>>, gold_answer string")
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)^\s*$")
    wrong = F.raise_error(F.concat(F.lit(f"a question without id or text in {path} at line "), F.col("line_no").cast("string")))
    return rows.where(F.when(blank("question_id") | blank("question"), wrong).otherwise(True)).drop("file", "line_no")


#: Shares of a chunk's text and of its section in the score of a retrieval mode, and digits that scores are rounded to.
MODES, DIGITS = {"vector": (0.75, 0.25), "graph": (0.55, 0.45)}, 12


def base_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, doc_id, page, section, text_score, section_score) of every question with every chunk.

    The questions are an evaluation's bounded set. Scores don't depend on the experiment, so all share them.
    """
    q = questions.select("question_id", token_set(F.col("question")).alias("q"))
    c = chunks.select("chunk_id", "doc_id", "page", "section", token_set(F.col("chunk_text")).alias("t"), token_set(F.col("section")).alias("s"))
    return c.crossJoin(q).select("question_id", "chunk_id", "doc_id", "page", "section", jaccard(F.col("q"), F.col("t")).alias("text_score"), jaccard(F.col("q"), F.col("s")).alias("section_score"))


def base_candidates(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Of `base_scores` rows among which are those that `matrix_hits` takes: each batch of chunks gives a question's k best
    in either mode. Pairs are neither made nor shuffled; see `vectors.in_blocks`."""
    q = questions.select("question_id", token_set(F.col("question")).alias("value"))
    c = chunks.select("chunk_id", "doc_id", "page", "section", token_set(F.col("chunk_text")).alias("t"), token_set(F.col("section")).alias("s"))
    order = ["doc_id", "page", "section", "chunk_id"]
    prepared, counted = token_counting()

    def units(score: np.ndarray) -> np.ndarray:
        """Scores in units of the last of DIGITS, rounded as Spark does: by their decimals, half up."""
        scaled = score * 10.0**DIGITS
        out = np.floor(scaled + 0.5)
        for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3), strict=True):  # the product may have crossed the half
            out[at] = float(Decimal(repr(float(score[at]))).scaleb(DIGITS).to_integral_value(ROUND_HALF_UP))
        return out

    def best(ids: pa.Array, state: Tokens, batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.take(pc.sort_indices(batch, sort_keys=[(x, "ascending") for x in order], null_placement="at_start"))
        text, section = [np.where(union > 0, shared / np.maximum(union, 1), 0.0) for shared, union in (counted(state, batch.column(x)) for x in ("t", "s"))]
        taken = np.zeros(text.shape, bool)
        for a, b in MODES.values():
            # the sort is stable, so of equal scores the first row in order comes first
            np.put_along_axis(taken, np.argsort(-units(a * text + b * section), axis=1, kind="stable")[:, : max(1, k)], True, 1)
        n, at = np.nonzero(taken)
        rows = batch.select(["chunk_id", *order[:3]]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(n)), *rows.columns, pa.array(text[n, at]), pa.array(section[n, at])], names=["question_id", *rows.schema.names, "text_score", "section_score"])

    kinds = ", ".join(f"{x} {df.schema[x].dataType.simpleString()}" for df, names in ((q, ["question_id"]), (c, ["chunk_id", *order[:3]])) for x in names)
    return in_blocks(q, c, prepared, best, f"{kinds}, text_score double, section_score double")


def matrix_hits(base: DataFrame, experiments: DataFrame, k: int) -> DataFrame:
    """(exp_id, question_id, rank, chunk_id) for all experiments at once. `base` are the scores of all pairs, or of
    candidates for at least this k; as it is read for each mode and side, it should be fixed.

    Within a retrieval mode the factors scale all scores alike, so each mode is ranked once; the fused mode depends on
    the scales of its two sides.
    """
    order = [F.col("doc_id"), F.col("page"), F.col("section"), F.col("chunk_id")]
    sides = {m: base.withColumn("score", F.round(a * F.col("text_score") + b * F.col("section_score"), DIGITS)) for m, (a, b) in MODES.items()}
    top = {m: top_k(df, k, order=order).select("question_id", "chunk_id", "rank", "score") for m, df in sides.items()}
    scale = {"vector": value_scale(F.col("chunking"), 0.001) * value_scale(F.col("embedding"), 0.001), "graph": value_scale(F.col("chunking"), 0.001)}
    out = None
    for mode in ("vector", "graph"):
        part = experiments.where(F.col("retrieval") == mode).select("exp_id").crossJoin(top[mode]).select("exp_id", "question_id", "rank", "chunk_id")
        out = part if out is None else out.unionByName(part)
    hybrid = experiments.where(~F.col("retrieval").isin("vector", "graph"))
    pair = F.concat_ws("|", "exp_id", F.col("question_id").cast("string"))
    scaled = {m: hybrid.crossJoin(top[m]).select(pair.alias("question_id"), "chunk_id", "rank", F.round(F.col("score") * scale[m], 12).alias("score")) for m in top}
    mixed = fused(scaled["vector"], scaled["graph"], k)
    mixed = mixed.select(F.substring_index("question_id", "|", 1).alias("exp_id"), F.substring_index("question_id", "|", -1).alias("question_id"), "rank", "chunk_id")
    return out.withColumn("question_id", F.col("question_id").cast("string")).unionByName(mixed)


def leaderboard(rows: DataFrame) -> DataFrame:
    """Experiments by nDCG and recall, best first, then by latency."""
    w = Window.orderBy(F.desc("ndcg"), F.desc("recall"), *([F.col("latency_ms")] if "latency_ms" in rows.columns else []), F.col("exp_id"))
    return rows.withColumn("place", F.row_number().over(w))


def ab_runs(run: Callable[[int], DataFrame], variants: tuple[str, str], n_runs: int = 1) -> DataFrame:
    """(variant, score) of paired runs: for each run and question one score of either variant.

    `run` gives (question_id, variant, score) of a run by its number; a question that a variant didn't score, or scored
    with null, counts as 0 for it. Rows of other variants don't take part.
    """
    if n_runs < 1:
        raise ValueError("n_runs must be at least 1")
    out = None
    for k in range(n_runs):
        rows = run(k).where(F.col("variant").isin(*variants))
        sides = rows.groupBy("question_id").agg(*[F.coalesce(F.max(F.when(F.col("variant") == v, F.col("score"))), F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(variants)])
        both = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"s{i}").cast("double").alias("score")) for i, v in enumerate(variants)])
        pairs = sides.select(F.inline(both))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def compared(scores: DataFrame) -> DataFrame:
    """(variant, score) of two variants: mean, population deviation, Welch's t, its degrees of freedom and p-value.

    t, df and p_value are null where a variant has less than two scores, or neither varies. Repeated runs of
    deterministic variants add equal scores, which shrinks the error that t sees.
    """
    s = scores.groupBy("variant").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.var_samp("score").alias("v"))
    names = s.agg(F.min("variant").alias("a"), F.max("variant").alias("b"))
    side = lambda k, x: names.join(s, F.col(k) == F.col("variant")).select(*[F.col(c).alias(f"{c}_{k}") for c in ("variant", "n", "mean", "std", "v")])
    both = side("a", s).crossJoin(side("b", s))
    ea, eb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    both = both.withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0)))
    # the parts of the error, so that small variances don't vanish when squared
    pa, pb = ea / F.nullif(ea + eb, F.lit(0.0)), eb / F.nullif(ea + eb, F.lit(0.0))
    both = both.withColumn("df", 1 / F.nullif(pa * pa / F.nullif(F.col("n_a") - 1, F.lit(0)) + pb * pb / F.nullif(F.col("n_b") - 1, F.lit(0)), F.lit(0.0)))
    winner = F.when(F.col("mean_a") > F.col("mean_b"), F.col("variant_a")).when(F.col("mean_b") > F.col("mean_a"), F.col("variant_b"))
    return both.withColumn("p_value", t_test_p_value(F.col("t"), F.col("df"))).withColumn("winner", winner).drop("v_a", "v_b")


MEANS = ("recall_at_5", "recall_at_10", "ndcg_at_5", "ndcg_at_10", "citation_precision", "faithfulness_proxy")


def experiment_means(rows: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """(exp_id, question_id, MEANS...) to a row for each experiment with the mean of each metric, a missing value as 0.

    `latency` (stage, metric_name, value) are metric rows of the experiments' timers, the stage being the exp_id: their
    seconds, added up, are latency_ms; null where an experiment wasn't timed.
    """
    out = rows.groupBy("exp_id").agg(*[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in MEANS])
    if latency is None:
        return out.withColumn("latency_ms", F.lit(None).cast("double"))
    took = latency.where(F.col("metric_name").endswith(".seconds")).groupBy(F.col("stage").alias("exp_id")).agg((F.sum("value") * 1000).alias("latency_ms"))
    return out.join(took, "exp_id", "left")
