"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of postings, cut into segments of whole documents: a row holds the places of one word in one
segment. The words of a segment's documents are numbered through, with one number left out after each document, so that
no phrase reaches from one into the next. Making it takes one pass over the texts and no shuffle, and a frequent word
has as many rows as there are segments.

A phrase starts from the postings of its rarest word: only segments that hold it are candidates. There its places, less
the word's offset in the phrase, are intersected with those of the other words, the rarest first, until none is left or
all words have agreed. Nearby words in any order are found from the rarest word's places too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python, scratch, written

#: Words of a document are runs of letters and digits of ASCII and of all characters beyond; A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same over bytes: what each byte becomes, before a text is split at blanks.
BYTES = bytes(x + 32 if chr(x) in UPPER else x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256))
WINDOW = 10
#: Words after which a segment ends, with the document that reaches it; what a task holds at a time.
SEGMENT_WORDS = 1 << 20
#: What may be broadcast of the phrases' words, as counted, and what a row takes besides its bytes.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
INDEX = "segment long, token string, n int, places array<int>, doc_ids array<long>, n_words array<int>"


def words(text: bytes | None) -> list[bytes]:
    """Of UTF-8."""
    return (text or b"").translate(BYTES).split()


def index_of(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(doc_id, text) to postings (segment, token, n, places); a row without a token lists a segment's documents in order.

    doc_ids and n_words are those of the segment's documents: one entry a row of `docs`, repeated and null doc_ids too.
    A null text has no words. Further columns don't take part. Written; an empty frame gives an empty index.
    """
    schema = pa.schema([("segment", pa.int64()), ("token", pa.string()), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32()))])

    def segment(name: int, found: list[bytes], doc_ids: list[int | None], counts: list[int]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found))
        n = np.array(counts, np.int64)
        place = (np.arange(len(found)) + np.repeat(np.arange(len(n)), n)).astype(np.int32)[np.argsort(code, kind="stable")]
        of = np.bincount(code, minlength=len(numbers)).astype(np.int32)
        ends = np.r_[0, np.cumsum(of)].astype(np.int32)
        rows, none = len(numbers), lambda k, kind: pa.nulls(k, kind)
        if rows:
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(place))
            tokens = pa.array(list(numbers), pa.binary()).cast(pa.string())
            columns = [pa.array(np.full(rows, name)), tokens, pa.array(of), listed, none(rows, schema[4].type), none(rows, schema[5].type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([name]), none(1, pa.string()), pa.array([len(n)], pa.int32()), none(1, schema[3].type), pa.array([doc_ids], schema[4].type), pa.array([counts], schema[5].type)], schema=schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found, doc_ids, counts = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = words(text.as_py())
                found += own
                doc_ids.append(doc_id)
                counts.append(len(own))
                if len(found) + len(counts) >= segment_words:
                    yield from segment(name, found, doc_ids, counts)
                    name, found, doc_ids, counts = name + 1, [], [], []
        if counts:
            yield from segment(name, found, doc_ids, counts)

    ready_for_python(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, INDEX), "phrases-index")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, text) to (item_id, terms): all runs of `size` words, or the whole of an item with fewer; none without words."""
    found = items.select("item_id", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return found.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))


def small(df: DataFrame, text: str) -> DataFrame:
    """A written table, to be broadcast if its counted rows with their column `text` (a string) are small."""
    size = df.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    return F.broadcast(df) if (size[0] or 0) + ROW_BYTES * size[1] <= BROADCAST_BYTES else df


def planned(index: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases (phrase, terms) with their words from the rarest on, and the words: both written.

    (phrase, rarest, terms, offsets), without phrases of which some word occurs nowhere; and (token) of those.
    """
    each = phrases.select("phrase", F.posexplode("terms").alias("offset", "token"))
    tokens = written(each.select("token").distinct(), "phrases-tokens")
    counts = index.where("token IS NOT NULL").select("token", "n").join(small(tokens, "token"), "token", "left_semi")
    counts = written(counts.groupBy("token").agg(F.sum("n").alias("of")), "phrases-counts")
    ordered = each.join(small(counts, "token"), "token", "left").groupBy("phrase")
    ordered = ordered.agg(F.sort_array(F.collect_list(F.struct("of", "token", "offset"))).alias("s"))  # the words of one phrase
    ordered = ordered.where(~F.exists("s", lambda x: x["of"].isNull()))
    plan = written(ordered.select("phrase", F.col("s")[0]["token"].alias("rarest"), F.col("s.token").alias("terms"), F.col("s.offset").alias("offsets")), "phrases-plan")
    return plan, written(plan.select(F.explode("terms").alias("token")).distinct(), "phrases-needed")


class Segment:
    """The postings of some words in one segment, and its documents."""

    def __init__(self, table: pa.Table):
        tokens, places = table.column("token").combine_chunks(), table.column("places").combine_chunks()
        values, ends = places.values.to_numpy(zero_copy_only=False), places.offsets.to_numpy()
        self.places, self.doc_ids, self.n_words = {}, [], np.zeros(0, np.int64)
        for k, token in enumerate(tokens.to_pylist()):
            if token is None:
                self.doc_ids = table.column("doc_ids")[k].as_py()
                self.n_words = np.array(table.column("n_words")[k].as_py(), np.int64)
            else:
                self.places[token] = values[ends[k] : ends[k + 1]]
        self.starts = np.cumsum(self.n_words + 1) - (self.n_words + 1)

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The number in the segment of the document that each place is in."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, terms: list[str], offsets: list[int]) -> np.ndarray:
        """Where a phrase starts; its words come from the rarest on."""
        at = None
        for term, offset in zip(terms, offsets, strict=True):
            own = self.places.get(term)
            if own is None:
                return np.zeros(0, np.int64)
            if at is None:
                at = own.astype(np.int64) - offset
            else:
                at = at[own[np.minimum(np.searchsorted(own, at + offset), len(own) - 1)] == at + offset]
            if not len(at):
                break
        return at

    def near(self, terms: list[str], within: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the shortest stretches of one document, `within` words at most, that hold all the
        words, in any order and each as often as it is given. Of stretches with one end the shortest counts, and none
        that holds another."""
        need = {t: terms.count(t) for t in terms}  # in the order of `terms`, the rarest first
        if any(t not in self.places or len(self.places[t]) < m for t, m in need.items()):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.unique(np.concatenate([self.places[t] for t in need])).astype(np.int64)
        rare = self.places[next(iter(need))]
        ahead = rare[np.minimum(np.searchsorted(rare, left), len(rare) - 1)]
        left = left[(ahead >= left) & (ahead < left + within)]
        last = left.copy()
        for t, m in need.items():
            own = self.places[t].astype(np.int64)
            k = np.searchsorted(own, left) + m - 1
            last = np.maximum(last, np.where(k < len(own), own[np.minimum(k, len(own) - 1)], np.iinfo(np.int64).max))
        fits = (last < left + within) & (self.documents(left) == self.documents(last))
        left, last = left[fits], last[fits]
        shortest = np.r_[last[1:] != last[:-1], True][: len(last)]  # both rise, so the rightmost start of an end is its shortest
        return left[shortest], last[shortest]


def searched(index: DataFrame, phrases: DataFrame, found: Callable[[Segment, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`found` of each segment and the phrases (phrase, terms, offsets) whose rarest word it holds, none for many."""
    plan, needed = planned(index, phrases)
    tokens, here = index.where("token IS NOT NULL"), index.where("token IS NULL")
    small_plan = small(plan.withColumn("bytes", F.array_join("terms", " ")), "bytes").drop("bytes")
    candidates = tokens.select("segment", "token").join(small_plan, F.col("token") == F.col("rarest")).select(F.col("segment").alias("in_segment"), "phrase", "terms", "offsets")
    postings = tokens.join(small(needed, "token"), "token", "left_semi").unionByName(here)
    both = postings.groupBy("segment").cogroup(candidates.groupBy("in_segment"))
    return both.applyInArrow(lambda left, right: found(Segment(left), right), schema)


def _plans(table: pa.Table) -> Iterator[tuple[int, list[str], list[int]]]:
    return zip(*(table.column(c).to_pylist() for c in ("phrase", "terms", "offsets")), strict=True) if table.num_rows else iter(())


def occurrences(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact matches: (phrase long, terms array<string>) to (phrase, doc_id, at): where, by word from 0, in which row of
    the indexed documents. A phrase without words has none."""

    def found(segment: Segment, plans: pa.Table) -> pa.Table:
        hits = [(p, segment.phrase(terms, offsets)) for p, terms, offsets in _plans(plans)]
        at = np.concatenate([x for _, x in hits] or [np.zeros(0, np.int64)])
        doc = segment.documents(at)
        return pa.table({"phrase": pa.array(np.repeat(np.array([p for p, _ in hits], np.int64), [len(x) for _, x in hits])), "doc_id": pa.array([segment.doc_ids[k] for k in doc], pa.int64()), "at": pa.array(at - segment.starts[doc], pa.int64())})

    return searched(index, phrases, found, "phrase long, doc_id long, at long")


def nearby(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """Proximity matches: (phrase, doc_id, at, last): the shortest stretches of at most `within` words of a document that
    hold all words of a phrase, in any order and as often as the phrase has them."""

    def found(segment: Segment, plans: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for p, terms, _ in _plans(plans):
            left, last = segment.near(terms, within)
            doc = segment.documents(left)
            out += [(p, segment.doc_ids[d], a - segment.starts[d], b - segment.starts[d]) for a, b, d in zip(left, last, doc, strict=True)]
        return pa.table({c: pa.array([None if r[k] is None else int(r[k]) for r in out], pa.int64()) for k, c in enumerate(("phrase", "doc_id", "at", "last"))})

    return searched(index, phrases, found, "phrase long, doc_id long, at long, last long")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) to (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A row for each row of `docs`, repeated and null doc_ids too. n_hit counts the words inside any occurrence of a
    window of an item: `size` words in a row, or all of an item with fewer. n_items counts the different item_ids with
    windows that occur, items_sha256 is the digest of these, sorted as strings and joined by commas. A null or empty text has no words and
    no hits; an item without words or without an id counts for nothing. Texts are read whole; further columns don't
    take part; without documents the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    with scratch(spark) as keep:
        index = index_of(docs)
        cut = written(windows(items.where("item_id IS NOT NULL"), size).withColumn("key", F.array_join("terms", " ")), "phrases-windows")
        phrases = written(cut.groupBy("key").agg(F.first("terms").alias("terms")).withColumn("phrase", F.monotonically_increasing_id()), "phrases-distinct")
        owners = written(cut.join(phrases.select("key", "phrase"), "key").select("phrase", F.col("item_id").cast("string").alias("item")).distinct(), "phrases-owners")

        def found(segment: Segment, plans: pa.Table) -> pa.Table:
            steps = np.zeros(int((segment.n_words + 1).sum()) + 1, np.int32)
            by_doc: dict[int, list[int]] = {}
            for p, terms, offsets in _plans(plans):
                at = segment.phrase(terms, offsets)
                steps[at] += 1  # a phrase starts at a place once
                steps[at + len(terms)] -= 1
                for k in np.unique(segment.documents(at)).tolist():
                    by_doc.setdefault(k, []).append(p)
            hit = np.r_[0, np.cumsum(np.cumsum(steps) > 0)]
            n_hit = hit[segment.starts + segment.n_words] - hit[segment.starts]
            rows = len(segment.doc_ids)
            return pa.table({"at": pa.array(np.arange(rows)), "doc_id": pa.array(segment.doc_ids, pa.int64()), "n_words": pa.array(segment.n_words), "n_hit": pa.array(n_hit), "phrases": pa.array([by_doc.get(k) for k in range(rows)], pa.list_(pa.int64()))})

        hits = searched(index, phrases.select("phrase", "terms"), found, "at long, doc_id long, n_words long, n_hit long, phrases array<long>")
        hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "phrases-hits")
        named = hits.select("row", F.explode("phrases").alias("phrase")).join(small(owners, "item"), "phrase").groupBy("row")
        named = named.agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most all items
        named = keep(written(named.select("row", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "phrases-named"))
        keep(hits)
    out = hits.join(named, "row", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.lit(none)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
g AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM w CROSS JOIN (SELECT DISTINCT n FROM p) WHERE len(words) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
