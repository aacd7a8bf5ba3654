"""Importance resampling towards a target distribution, by hashed n-grams and Gumbel noise.

Texts are scored from an array of gains, one for each bucket of hashed features. What is drawn without replacement are
the rows with the highest score, weight plus noise. Each partition sorts its eligible rows into a run, which is stored
in blocks that carry their first key. Ranges of keys are merged beside each other: the blocks of a range come in the
order of their first keys, so a block is read only when the merge gets to it, and a tournament tree over the open blocks,
one a run at most, names the next rows. Ranges begin with the rank that the counts before them give; the one in which
the draw ends stops there, and those after it aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python, scratch, written
from .phrases import words

BUCKETS = 10_000
NGRAMS = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Rows of a range about, ranges at most, and first keys at most, about, that the driver looks at to part ranges.
RANGE, MOST_RANGES, SAMPLE = 1 << 13, 4096, 1 << 15
#: What rows are drawn by, the least first; `row` only parts rows that don't differ. `low` is the score with its sign changed.
KEY = ("low", "doc_id", "n_features", "row")
COLUMNS = (*KEY, "weight")
FIRST = ", ".join(f"first_{c} long" for c in KEY)
LISTS = ", ".join(f"{c} array<long>" for c in COLUMNS)


def features(text: bytes | None, ngrams: int = NGRAMS) -> tuple[int, np.ndarray]:
    """Number of words, and the hash of each run of 1 to `ngrams` words."""
    own = words(text)
    runs = own if ngrams == 1 else [b" ".join(own[k : k + n]) for n in range(1, ngrams + 1) for k in range(len(own) - n + 1)]
    return len(own), np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> np.ndarray:
    """Features of (text) in each bucket: one array a task, added up by bucket; the result has `buckets` numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(features(text.as_py(), ngrams)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: str = SEED) -> int:
    """Thousandths of a Gumbel variable that the id fixes."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, ngrams: int = NGRAMS, seed: str = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_features, weight, score, row); a null doc_id has no score. Written.

    `row` tells rows apart. A text without features has weight 0. `gains` goes to all tasks, 8 bytes a bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def batch_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for text in batch.column(1).cast(pa.binary()):
                n_words, hashes = features(text.as_py(), ngrams)
                out.append((n_words, len(hashes), int(gains[hashes % len(gains)].sum()) // len(hashes) if len(hashes) else 0))
            scores = [None if d is None else r[2] + noise(d, seed) for d, r in zip(batch.column(0).to_pylist(), out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], pa.int64()) for k in range(3)], pa.array(scores, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batch_scores, "doc_id long, n_words long, n_features long, weight long, score long")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "resampling-scored")


Key = tuple[int, ...]
#: Loses against every key.
NONE: Key = (1 << 64,)


class Tournament:
    """A binary tree of matches: each node knows which leaf below it has the least key. Putting a key replays one path."""

    def __init__(self):
        self.size, self.keys, self.tree, self.free = 1, [NONE], [0, 0], [0]

    def put(self, leaf: int, key: Key) -> None:
        self.keys[leaf] = key
        self.tree[node := leaf + self.size] = leaf
        while node := node // 2:
            one, two = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = two if self.keys[two] < self.keys[one] else one

    def place(self) -> int:
        """A leaf without a key; the tree doubles when there is none."""
        if not self.free:
            keys, self.size = self.keys, 2 * self.size
            self.keys, self.tree, self.free = [NONE] * self.size, [0] * self.size + list(range(self.size)), list(range(len(keys), self.size))
            for leaf in range(self.size):
                self.put(leaf, keys[leaf] if leaf < len(keys) else NONE)
        return self.free.pop()

    def leave(self, leaf: int) -> None:
        self.put(leaf, NONE)
        self.free.append(leaf)

    def winner(self) -> int:
        return self.tree[1]

    def runner_up(self) -> Key:
        """The least key but the winner's: that of one which lost to it."""
        node, best = self.winner() + self.size, NONE
        while node > 1:
            best = min(best, self.keys[self.tree[node ^ 1]])
            node //= 2
        return best


class Block:
    """Sorted rows of one run: an array for each of COLUMNS."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows, self.at = rows, 0

    def key(self, at: int) -> Key:
        return tuple(int(x[at]) for x in self.rows[: len(KEY)])

    def before(self, key: Key) -> int:
        """How many of its rows come before a key."""
        low, high = self.at, len(self.rows[0])
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.key(mid) < key else (low, mid)
        return low


def merged(blocks: Iterator[Block], most: int) -> Iterator[list[np.ndarray]]:
    """The first `most` rows of sorted blocks in their common order, in stretches that one block has.

    Blocks come by their first keys; one is taken from `blocks` only when the merge gets to its first key.
    """
    tree, open_blocks, following = Tournament(), {}, next(blocks, None)
    while most > 0:
        while following is not None and following.key(0) <= tree.keys[tree.winner()]:
            leaf = tree.place()
            open_blocks[leaf] = following
            tree.put(leaf, following.key(0))
            following = next(blocks, None)
        leaf = tree.winner()
        if tree.keys[leaf] == NONE:
            return
        block = open_blocks[leaf]
        until = tree.runner_up() if following is None else min(tree.runner_up(), following.key(0))
        end = min(block.at + most, max(block.at + 1, block.before(until)))
        yield [x[block.at : end] for x in block.rows]
        most, block.at = most - (end - block.at), end
        if end == len(block.rows[0]):
            del open_blocks[leaf]
            tree.leave(leaf)
        else:
            tree.put(leaf, block.key(end))


def _lists(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Row k's lists of COLUMNS, copied, as the batch doesn't last."""
    return [np.array(batch.column(batch.schema.get_field_index(c))[k].values.to_numpy(zero_copy_only=False)) for c in COLUMNS]


def _rows(blocks: list[tuple[Key, list[np.ndarray]]], more: dict[str, list[int]]) -> pa.RecordBatch:
    """Blocks with their first keys, and what else is said of each."""
    columns = {c: pa.array(x, pa.int64()) for c, x in more.items()} | {f"first_{c}": pa.array([key[k] for key, _ in blocks], pa.int64()) for k, c in enumerate(KEY)}
    columns |= {c: pa.array([rows[k] for _, rows in blocks], pa.list_(pa.int64())) for k, c in enumerate(COLUMNS)}
    return pa.RecordBatch.from_pydict(columns)


def runs_of(rows: DataFrame) -> DataFrame:
    """Rows of COLUMNS to blocks: each partition's in order, as many rows to a block as an Arrow batch has. Written."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(COLUMNS))]
            if batch.num_rows:
                yield _rows([(Block(own).key(0), own)], {})

    return written(rows.select(*COLUMNS).sortWithinPartitions(*KEY).mapInArrow(blocks, f"{FIRST}, {LISTS}"), "resampling-runs")


def parted(runs: DataFrame, ranges: int) -> DataFrame:
    """Blocks cut where ranges of keys begin: adds range and n. Written. Where ranges begin is chosen by a sample of first
    keys; any choice gives the same draw."""
    firsts = runs.select(*[f"first_{c}" for c in KEY])
    every = -(-firsts.count() // SAMPLE)
    sample = sorted(map(tuple, firsts.where(F.pmod(F.xxhash64("first_row"), F.lit(every)) == 0).collect())) if ranges > 1 else []
    starts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, name, n = [], [], []
            for k in range(batch.num_rows):
                block = Block(_lists(batch, k))
                for at, start in enumerate([*starts, NONE]):
                    end = block.before(start)
                    if end > block.at:
                        out.append((block.key(block.at), [x[block.at : end] for x in block.rows]))
                        name.append(at)
                        n.append(end - block.at)
                        block.at = end
                    if end == len(block.rows[0]):
                        break
            yield _rows(out, {"range": name, "n": n})

    return written(runs.mapInArrow(cut, f"range long, n long, {FIRST}, {LISTS}"), "resampling-ranges")


def drawn(rows: DataFrame, draws: int) -> DataFrame:
    """The `draws` rows of COLUMNS that come first in the order of KEY, with their rank from 1. Written."""
    pieces = parted(runs_of(rows), min(MOST_RANGES, -(-rows.count() // RANGE)))
    begin, n = {}, 0
    for r in sorted(pieces.groupBy("range").agg(F.sum("n").alias("n")).collect()):  # MOST_RANGES rows at most
        if n < draws:
            begin[r["range"]], n = n, n + r["n"]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column(0)[k].as_py(), batch, k) for batch in batches for k in range(batch.num_rows))
        row = next(rows, None)
        while row is not None:
            name, rank = row[0], begin[row[0]]

            def of_range(name: int = name) -> Iterator[Block]:
                nonlocal row
                while row is not None and row[0] == name:
                    block = Block(_lists(row[1], row[2]))
                    row = next(rows, None)
                    yield block

            blocks = of_range()
            held: list[list[np.ndarray]] = []
            for stretch in merged(blocks, draws - rank):
                held.append(stretch)
                if len(held) >= 1000:
                    yield _ranked(held, rank)
                    rank, held = rank + sum(len(x[0]) for x in held), []
            if held:
                yield _ranked(held, rank)
            while row is not None and row[0] == name:  # what comes after the draw
                row = next(rows, None)

    wanted = pieces.where(F.col("range") <= max(begin)).repartition("range").sortWithinPartitions("range", *[f"first_{c}" for c in KEY])
    return written(wanted.select("range", *COLUMNS).mapInArrow(ranked, ", ".join(f"{c} long" for c in (*COLUMNS, "rank"))), "resampling-drawn")


def _ranked(stretches: list[list[np.ndarray]], rank: int) -> pa.RecordBatch:
    columns = [np.concatenate([x[k] for x in stretches]) for k in range(len(COLUMNS))]
    columns.append(np.arange(rank + 1, rank + 1 + len(columns[0])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*COLUMNS, "rank"])


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, ngrams: int = NGRAMS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text) and target (text) to (doc_id, n_features, weight, score, rank), a row for each row of `docs`.

    Of the rows with at least `least_words` words floor(percent of their number) are drawn, the highest scores first;
    rank is null for the others. Ties go to the smaller doc_id, then to fewer features; rows that agree in these don't
    differ in the result. A null text has no words and weight 0. A row with a null doc_id counts for the source's
    features, but has no score and isn't drawn. Texts are read whole; further columns don't take part. An empty target
    has no features, so that rare buckets gain; without documents the result is empty.
    """
    ready_for_python(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, buckets, ngrams), bucket_counts(target, buckets, ngrams))
    with scratch(docs.sparkSession) as keep:
        rows = keep(scored(docs, gains, ngrams, seed)).withColumn("low", -F.col("score"))
        eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
        draws = percent * rows.where(eligible).count() // 100
        result = ["doc_id", "n_features", "weight", "score"]
        if not draws:
            return rows.select(*result, F.lit(None).cast("long").alias("rank"))
        first = keep(drawn(rows.where(eligible), draws))
    last = first.where(F.col("rank") == draws).first()
    after = F.struct(*KEY) > F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in KEY])
    rest = rows.where(~eligible | after)
    return first.withColumn("score", -F.col("low")).select(*result, "rank").unionByName(rest.select(*result, F.lit(None).cast("long").alias("rank")))


#: CRC-32 of short strings, as SQL has no function of that name: a table made by the rule, then a step for each byte.
CRC_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(hexed: str) -> str:
    """The CRC-32 of the bytes that an SQL expression gives in hexadecimal; `crc_table` must be among the tables."""
    steps = f"list_transform(range(0, len({hexed}), 2), lambda i: ('0x' || substr({hexed}, i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"


SQL = f"""
WITH {CRC_SQL},
w AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
f AS (SELECT side, doc_id, unnest(words) AS word FROM w),
v AS (SELECT word, {crc_sql("hexed")} % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS hexed FROM (SELECT DISTINCT word FROM f)), crc_table),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN v USING (word) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM n, a),
d AS (
  SELECT w.doc_id, len(any_value(words)) AS n_features, coalesce(floor(sum(gain)::DOUBLE / count(gain)), 0)::BIGINT AS weight
  FROM w LEFT JOIN (SELECT doc_id, gain FROM f JOIN v USING (word) JOIN g USING (bucket) WHERE side = 's') x ON x.doc_id = w.doc_id
  WHERE side = 's' GROUP BY w.doc_id),
z AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS draws FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= draws THEN rank END::BIGINT AS rank
FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""
