"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition under which a text is rejected. A sample gives each rule's cost (seconds a row above a plain
read) and its selectivity (share of rows it rejects); rules then run in descending order of rejection per cost, as one
CASE whose branches Spark evaluates only as far as the first that rejects. The order changes the time, never a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound, n_spaced, spaced_words

#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
SAMPLE_SHARE = 0.1
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_chars(spaced: Column, words: Column) -> Column:
    """Code points in words: all but the single spaces between them."""
    return F.coalesce(F.length(spaced) - F.greatest(words - 1, F.lit(0)), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    return F.coalesce(bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def window_hashes(spaced: Column, n: int) -> Column:
    """A hash for each window of n words, in order."""
    windows = F.regexp_extract_all(spaced, F.lit(rf"(?<![^ ])(?=((?:[^ ]++ ){{{n - 1}}}[^ ]++))"), F.lit(1))
    return F.transform(windows, lambda x: F.xxhash64(x))


def _covered(hashes: Column) -> Column:
    """How many words the windows cover whose hash comes twice or more.

    Sorted (hash, position) pairs put equal windows side by side; the positions of those with an equal neighbour, in
    order, cover `WINDOW` words each, less what the next one covers too.
    """
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i")))

    def positions(pairs: Column) -> Column:
        before = F.concat(none, F.slice(pairs, 1, F.size(pairs) - 1))
        after = F.concat(F.slice(pairs, 2, F.size(pairs)), none)
        sides = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
        at = F.zip_with(pairs, sides, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
        return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

    def words(at: Column) -> Column:
        following = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(None).cast("int")))
        steps = F.zip_with(at, following, lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bound(bound(pairs, positions), words)


def n_repeat_words(spaced: Column) -> Column:
    """Words that stand in an 8-word window found twice or more in the text, the first time included."""
    found = bound(window_hashes(spaced, WINDOW), lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), _covered(h)).otherwise(F.lit(0).cast("long")))
    return F.coalesce(found, F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules(words: Column, repeats: Column) -> list[Rule]:
    return [Rule("short", words < 20), Rule("repetition", repeats * 100 > words * 30)]


def further_rules(words: Column, chars: Column, symbols: Column, dup_lines: Column, lines: Column) -> list[Rule]:
    """Shapes that prose of any language doesn't have."""
    return [
        Rule("symbols", symbols * 10 > words),
        Rule("short_words", chars * 10 < words * 15),
        Rule("long_words", chars > words * 40),
        Rule("equal_lines", (dup_lines * 100 > lines * 30) & (dup_lines >= 3)),
    ]


def ordered(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample, the highest first; where that is empty, as they stand.

    The sample is every tenth row or so of the first partitions, as many of these as hold `sample_rows`; no others are
    read. Rules may read column text and the words of `spaced_words` in column __spaced.
    """
    rows = df.select("text").sample(SAMPLE_SHARE, seed=7).limit(sample_rows).collect()
    if not rows:
        return rules
    sample = df.sparkSession.createDataFrame(rows, "text string").withColumn("__spaced", spaced_words(F.col("text"))).cache()
    try:
        n = sample.count()

        def timed(what: Column) -> tuple[float, int]:
            begun = time.perf_counter()
            found = sample.agg(F.count_if(what)).first()[0]
            return time.perf_counter() - begun, found

        plain = min(timed(F.length("text") < 0)[0] for _ in range(2))
        rank = {}
        for rule in rules:
            seconds, rejected = timed(rule.rejects)
            rank[rule.name] = rejected / n / max(seconds - plain, 1e-4)
        return sorted(rules, key=lambda r: -rank[r.name])
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null where none does; later rules aren't evaluated then."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(df: DataFrame, counts: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds kept boolean and, if `counts`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Needs a column text; all others stay, but those of the names that are added are replaced. A null or empty text has
    no words and is rejected as too short. Rows are judged one by one, so repeated rows get equal verdicts. An empty
    frame gives an empty frame. Windows and lines are compared by 64-bit hashes within a text.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    df = df.select(*[c for c in df.columns if c not in added])
    text, spaced = F.col("text"), F.col("__spaced")
    lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(1))

    def counted(spaced: Column, words: Column) -> list[Column]:
        return [words, word_chars(spaced, words), n_symbols(text), n_dup_lines(text)]

    if not counts:
        def rules(spaced: Column, words: Column) -> list[Rule]:
            return base_rules(words, n_repeat_words(spaced)) + further_rules(*counted(spaced, words), lines)

        order = [r.name for r in ordered(df, rules(spaced, n_spaced(spaced)), sample_rows)]

        def verdict(spaced: Column, words: Column) -> Column:
            named = {r.name: r for r in rules(spaced, words)}
            return cascade([named[name] for name in order])

        # every rule reads the words, so they are bound: a filter on the verdict would take them from the text again for each
        return df.withColumn("kept", bound(spaced_words(text), lambda s: bound(n_spaced(s), lambda n: verdict(s, n))).isNull())
    plain = counted(spaced, n_spaced(spaced))
    df = df.withColumn("__spaced", spaced_words(text))  # more than one column reads it, so it's computed once
    rules = ordered(df, further_rules(*plain, lines), sample_rows)
    names = {r.name: r for r in further_rules(*map(F.col, added[:4]), lines)}
    failed = F.lit(False)
    for rule in base_rules(F.col("n_words"), F.col("n_repeat_words")):
        failed = failed | rule.rejects
    df = df.withColumns(dict(zip(added, [*plain, n_repeat_words(spaced)], strict=False))).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & cascade([names[r.name] for r in rules]).isNull()).drop("__spaced")


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
s AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM f),
r AS (SELECT doc_id, sum(step)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(string_split(text, chr(10))) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_symbols * 10 > n_words)
       AND NOT (word_chars * 10 < n_words * 15) AND NOT (word_chars > n_words * 40)
       AND NOT (n_dup_lines * 100 > n_lines * 30 AND n_dup_lines >= 3) AS kept
FROM c
"""
