"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

A text's set holds its distinct 5-word shingles as 64-bit hashes. Two sets of a and b shingles link if their Jaccard
similarity is at least 0.8; they then share at least o(a) = ceil(0.8 a) shingles. All sets are put into one order of
shingles, the frequent ones last. Then for every l the first a - o(a) + l shingles of the one set and b - o(b) + l of
the other have at least l in common, and more if the sizes are near each other (`required`).

* Equal sets are one class; only one document of a class is joined.
* The order is estimated from counts over all documents: shingles in FREQUENT documents or more, the most frequent
  MOST_FREQUENT of them, come last, by count; the others come by hash. Any order gives the same result.
* With l = 1 the prefixes of all classes are counted. Shingles in one prefix only are of no use.
* Long lists, as large groups of near copies make them, are tied together by pivots first, which names no pairs within
  a component. Only candidates of different components are left.
* A class that has many candidates then gets a longer prefix: l grows with their number, which the longest of its lists
  estimates. It needn't look up the most frequent of its prefix shingles, as l of them or more must be shared.
* A candidate pair's shared prefix shingles are counted, and only pairs that share what `required` asks for are
  verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, ready_for_python, scratch, written
from .components import components
from .pivots import PERCENT, ids_of, labelled, least_overlap, linked, mixed_lists, of_checked_size, remaining, required_within, tied

WORDS = 5
#: Shingles in so many documents or more are frequent; at most so many are broadcast, 16 bytes each: all those above a
#: step of their counts, of which each doubling has STEPS.
FREQUENT, MOST_FREQUENT, STEPS = 16, 1 << 21, 16
#: Shingles counted together in one task, and sent to it in one piece.
COUNTED, SENT = 1 << 22, 1 << 21
#: The longest list that isn't tied together by pivots, and the candidates for which l stays 1.
SHORT, CHEAP = 16, 16
#: With CHEAP candidates doubled so many times, a whole set is looked at.
DOUBLINGS = 6
#: Fixed odd numbers that tell a shingle's places apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: of all 5-word windows, or of the whole if it has fewer words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(WORDS, len(h))
    if not span:
        return h.view(np.int64)
    x = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        x += h[k : len(h) - span + 1 + k] * FACTORS[k]
    x ^= x >> np.uint64(29)
    x *= FACTORS[1]
    x ^= x >> np.uint64(32)
    return np.unique(x.view(np.int64))


def _short(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (the top bits) and the next 32 bits of each shingle."""
    x = tokens.view(np.uint64)
    return (x >> np.uint64(64 - bits)).astype(np.int64), ((x >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Order:
    """The order of shingles: a number for each by which sets are sorted."""

    def __init__(self, bits: int, keys: np.ndarray):
        """`keys`: bucket and next 32 bits of the frequent shingles, the most frequent one last."""
        at = np.argsort(keys, kind="stable")
        self.bits, self.keys, self.rank = bits, keys[at], at

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """-1 for shingles that aren't frequent, for others their place among those."""
        if not len(self.keys) or not len(tokens):
            return np.full(len(tokens), -1, np.int64)
        high, low = _short(tokens, self.bits)
        key = (high << np.int64(32)) | low.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def put(self, tokens: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles, in this order."""
        ranks = self.ranks(tokens)
        return tokens[np.argsort(ranks, kind="stable")] if (ranks >= 0).any() else tokens


def order_of(docs: DataFrame) -> Order:
    """The order of the shingles of (text), counted over all documents.

    Tasks send sorted shingles with their counts in pieces to the buckets that they belong to; a bucket is chosen small
    enough to be counted in one task. Shingles that agree in their first 32 + bits bits are counted together, which
    may only put them further back.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total / 6 / COUNTED)))))

    def pieces(tokens: list[np.ndarray]) -> pd.DataFrame:
        high, low = _short(np.sort(np.concatenate(tokens).view(np.uint64)).view(np.int64), bits)
        new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        counts = np.minimum(np.diff(np.r_[new, len(high)]), 65535).astype(np.uint16)
        high, low = high[new], low[new]
        cut = np.searchsorted(high, np.arange((1 << bits) + 1))
        out = [(b, low[i:j].tobytes(), counts[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        return pd.DataFrame(out, columns=["bucket", "tokens", "counts"])

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for text in frame["text"]:
                held.append(shingles(text))
                n += len(held[-1])
                if n > SENT:
                    yield pieces(held)
                    held, n = [], 0
        if n:
            yield pieces(held)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["tokens"]])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["counts"]])
        at = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[at], counts[at].astype(np.int64)
        new = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        df, tokens = np.add.reduceat(counts, new), tokens[new]
        often = df >= FREQUENT
        return pd.DataFrame({"key": (np.int64(frame["bucket"].iloc[0]) << np.int64(32)) | tokens[often].astype(np.int64), "df": df[often]})

    buckets = docs.select("text").mapInPandas(sent, "bucket long, tokens binary, counts binary").groupBy("bucket")
    often = written(buckets.applyInPandas(counted, "key long, df long").withColumn("step", F.floor(F.log2("df") * STEPS).cast("int")), "op10-often")
    least, n = 64 * STEPS, 0
    for r in sorted(often.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):  # 64 * STEPS rows at most
        n += r["n"]
        if n > MOST_FREQUENT:
            break
        least = r["step"]
    keys = often.where(F.col("step") >= least).select("df", "key").toArrow()
    df, key = (keys.column(c).to_numpy() for c in ("df", "key"))
    discarded(often)
    return Order(bits, np.array(key[np.lexsort((-key, df))], np.int64))


def prefixes(docs: DataFrame, order: Order) -> DataFrame:
    """(doc_id, text) to (doc_id, n, f, g, pre): size and digest of the set, and its prefix for l = 1. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        for frame in frames:
            out = []
            for text in frame["text"]:
                x = shingles(text)
                n, digest = len(x), np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                out.append((n, digest[0], digest[1], order.put(x)[: n - -(-n * PERCENT // 100) + 1]))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64")} | {c: [r[k] for r in out] for k, c in enumerate(("n", "f", "g", "pre"))})

    return written(docs.mapInPandas(made, "doc_id long, n int, f long, g long, pre array<long>"), "op10-made")


def whole_sets(docs: DataFrame, ids: DataFrame, order: Order) -> DataFrame:
    """(id, set) for the ids, in order; written. Of rows that repeat a doc_id the one with the least digest is taken."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "set": [order.put(shingles(x)) for x in frame["text"]]})

    some = docs.select(F.col("doc_id").alias("id"), "text").join(of_checked_size(ids), "id", "left_semi")
    return written(some.mapInPandas(made, "id long, set array<long>"), "op10-whole")


def classes(docs: DataFrame, order: Order) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text): (doc_id, n, id) for every row, where `id` is the smallest doc_id with an equal set, null for
    an empty set or doc_id; and (id, n, pre) for every class, with the shingles of its prefix. Both written."""
    made = prefixes(docs, order)
    first = written(made.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f", "g").agg(F.min("doc_id").alias("id")), "op10-first")
    rows = made.select("doc_id", "n", "f", "g").join(of_checked_size(first), ["n", "f", "g"], "left")
    rows = written(rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "op10-rows")
    sets = made.withColumnRenamed("doc_id", "id").join(of_checked_size(first), ["id", "n", "f", "g"], "left_semi")
    sets = written(sets.select("id", "n", "pre"), "op10-sets")
    discarded(made)
    discarded(first)
    return rows, sets


def links(docs: DataFrame, sets: DataFrame, order: Order) -> DataFrame:
    """Links (a, b) between classes that give the components of all links.

    `sets` has (id, n, pre), one row a class, and each id stands for one text of `docs`.
    """
    posts = sets.select("id", "n", F.explode("pre").alias("token"))
    counts = written(posts.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "op10-counts")
    posts = written(posts.join(of_checked_size(counts), "token"), "op10-posts")
    discarded(counts)

    def verified(pairs: DataFrame) -> DataFrame:
        whole = whole_sets(docs, written(ids_of(pairs), "op10-ids"), order)
        out = written(linked(pairs, whole), "op10-linked")
        discarded(whole)
        return out

    # a class can't link in a list whose sizes all ask for more shared shingles than its prefix shares with any other
    kept = written(posts.groupBy("id").agg(F.count("*").cast("int").alias("kept")), "op10-kept")
    sizes = written(posts.groupBy("token").agg(F.min("n").alias("fewest"), F.max("n").alias("most")), "op10-sizes")
    n, one = F.col("n"), F.lit(1)
    hope = F.col("kept") >= required_within(n, F.col("fewest"), F.col("most"), one, one)
    posts = written(posts.join(of_checked_size(kept), "id").join(of_checked_size(sizes), "token").where(hope).select("token", "id", "n", "df"), "op10-hopeful")
    found, _ = tied(posts.where(F.col("df") > SHORT).select("token", "id", "n"), verified)

    # candidates of different components, with l by their cost
    left = written(mixed_lists(labelled(posts, found)).select("token", "id", "n", "label"), "op10-left")
    lists = written(left.groupBy("token").agg(F.count("*").alias("df")), "op10-lists")
    cost = left.join(of_checked_size(lists), "token").groupBy("id", "n", "label").agg(F.max("df").alias("cost"))
    part = F.least((1 + F.floor(F.log2(F.col("cost") / CHEAP))) / DOUBLINGS, F.lit(1.0))
    l = F.when(F.col("cost") > CHEAP, F.ceil(least_overlap(n) * part)).otherwise(1)  # noqa: E741
    cost = written(cost.select("id", "n", "label", l.cast("int").alias("l")), "op10-cost")
    rows = left.join(of_checked_size(cost.select("id", "l")), "id").select("token", "id", "n", "label", "l")
    costly = written(cost.where("l > 1"), "op10-costly")
    if not costly.isEmpty():
        longer = whole_sets(docs, costly.select("id"), order).join(of_checked_size(costly), "id")
        longer = longer.select(F.explode(F.slice("set", 1, n - least_overlap(n) + F.col("l"))).alias("token"), "id", "n", "label", "l")
        rows = rows.where("l = 1").unionByName(longer)
    rows = written(rows, "op10-longer")
    return remaining(rows, verified, found)


def _rows_and_labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id) for every row and (id, least) for every class that links; doc_ids that aren't null differ."""
    order = order_of(docs)
    rows, sets = classes(docs, order)
    found = links(docs, sets, order)
    return rows, written(components(found).toDF("id", "least"), "op10-labels")


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), a row for each row.

    component_id is the smallest doc_id that links reach, the row's own included. A null, empty or blank text has an
    empty set and links with nothing; a text of less than five words is one shingle. A null doc_id takes part in no
    link, and its component_id is null. doc_id names a document: where rows with different texts repeat one, a link of
    any of them counts for all. Texts are read whole. Further columns don't take part; an empty frame gives an empty
    frame.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    docs = docs.select("doc_id", "text")
    with scratch(spark) as keep:
        if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
            rows, labels = map(keep, _rows_and_labels(docs))
        else:  # rows are joined first, then the documents that rows name
            keyed = written(docs.withColumn("row", F.monotonically_increasing_id()), "op10-keyed")
            rows, labels = _rows_and_labels(keyed.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"))
            nodes = rows.where("doc_id IS NOT NULL").join(labels, "id", "left").select(F.col("doc_id").alias("row"), "n", F.coalesce("least", "id", "doc_id").alias("class"))
            nodes = written(nodes.join(keyed.select("row", "doc_id"), "row"), "op10-nodes")
            first = nodes.groupBy("class").agg(F.min("doc_id").alias("first"))
            labels = keep(written(components(nodes.join(first, "class").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))).toDF("id", "least"), "op10-labels"))
            rows = keep(written(nodes.select("doc_id", "n", F.col("doc_id").alias("id")).unionByName(rows.where("doc_id IS NULL")), "op10-rows"))
    labelled = rows.join(of_checked_size(labels), "id", "left")
    return labelled.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id", "doc_id").alias("component_id"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE shared * 100 >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
