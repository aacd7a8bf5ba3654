"""The trie of conversation prefixes, by Patricia construction.

A turn is named by the digest of its role and text, and a conversation by the digests of its turns in a row. Equal
conversations are one sequence. Sequences are sorted, in ranges; along each range a stack holds the points on the path
of the sequence at hand. Points are only made where sequences branch or end; the edge to a point stands for all the
nodes on it. Counts are summed on points, and when a point's parent is complete, its edge is expanded: the nodes on it
have the point's members, and their saved tokens are sums over the rest of the edge.

What is below a prefix of a range's first or last sequence may go on in another range. Such a prefix is left open: its
range says what it holds beside other open points, and a second trie of the first and last sequences alone, two for each
range, adds this up and gives the counts of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python, scratch, written
from .pivots import of_checked_size
from .resampling import CRC_SQL, crc_sql

GROUP, MOST_SHARED = 5, 9
#: Bytes that name a turn.
DIGEST = 16
NO_END = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
PART = ("depth", "n", "first", "children", "leaves", "saved")
PARTS = "array<struct<depth:long,n:long,first:long,children:long,leaves:long,saved:long,ends:string>>"
ROWS = f"kind string, node binary, {', '.join(f'{c} long' for c in NODE)}, ends_sha256 string, path binary, sizes array<long>, parts {PARTS}"
#: Rows sent at a time, and ids joined to one text.
SENT, PACKED = 5000, 2000


def turn_key(role: Column, text: Column) -> Column:
    """Names a turn: of 16 bytes, equal only for equal role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turns array<struct<key, bytes>>), a row for each conversation.

    Turns stand in the order of turn, null first; turns with one number in the order of their digests, repeated ones
    beside each other. A null role or text is empty. Rows with a null conv_id are no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    talks = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "bytes"))).alias("t"))
    return talks.select("conv_id", F.transform("t", lambda x: F.struct(x["key"], x["bytes"])).alias("turns"))


def rebuilt(talks: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """Conversations with their first h turns, h = crc32(conv_id) % most, taken from the first one of their group."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = talks.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.col("turns").alias("own"))
    joined = talks.withColumns({"head": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(heads, "head", "left")
    own = F.coalesce(F.slice("own", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(own, rest).alias("turns"))


def ends_of(named: DataFrame) -> DataFrame:
    """(name, conv_id) to (name, ends): the digest of each name's ids, in order and joined by commas.

    Ids are sorted in ranges, which part those of a frequent name; each range joins its ids to texts of PACKED at most,
    and only these texts, one after the other, go through the name's digest. None are held together.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, out = None, [], []
        rows = ((n, c) for batch in batches for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for name, conv in rows:
            if ids and (name != at or len(ids) == PACKED):
                out.append((at, ids[0], ",".join(map(str, ids))))
                ids = []
            at = name
            ids.append(conv)
            if len(out) >= SENT:
                yield _columns(out, "name", "first", "ids")
                out = []
        if ids:
            out.append((at, ids[0], ",".join(map(str, ids))))
        yield _columns(out, "name", "first", "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == at:
                    state.update(f",{ids}".encode())
                else:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = name, hashlib.sha256(ids.encode())
            yield _columns(out, "name", "ends")
        if at is not None:
            yield _columns([(at, state.hexdigest())], "name", "ends")

    texts = named.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(packed, "name string, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name string, ends string")


def _columns(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64() if c == "first" else pa.string()) for k, c in enumerate(names)})


def distinct(talks: DataFrame) -> DataFrame:
    """(conv_id, turns) to (path, sizes, n, first, ends): each sequence of turns once, with how many conversations have
    it, the first of these, and the digest of all."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["key"])), ""))
    named = talks.select("conv_id", path.alias("path"), F.col("turns.bytes").alias("sizes")).withColumn("name", F.sha2("path", 256))
    named = written(named, "trie-named")
    same = named.groupBy("name").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return same.join(ends_of(named.select("name", "conv_id")), "name").drop("name")


class Point:
    """A branch or end of sequences, at `depth` of the path at hand."""

    __slots__ = ("depth", "n", "first", "children", "leaves", "saved", "ends", "name", "below")

    def __init__(self, depth: int):
        self.depth, self.n, self.first, self.children, self.leaves, self.saved, self.ends, self.name = depth, 0, None, 0, 0, 0, NO_END, None
        self.below: list[tuple[Point, list[int]]] = []

    def add(self, n: int, first: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        self.first = first if self.first is None else self.first if first is None else min(self.first, first)


def shared(a: bytes, b: bytes) -> int:
    """With how many equal turns two paths begin."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST] else (low, mid - 1)
    return low


def prefix_name(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * DIGEST], digest_size=DIGEST).digest()


class Range:
    """The points of sorted sequences.

    `held` gets a row for each node: its kind, a name, the values of NODE and its ends. With `parts` False the sequences
    are all there are; names are those of nodes that were open. Else the prefixes of the first and the last sequence
    stay open: `open` gets (path, sizes, [(*values of PART, ends)]) of them, and a node right below one is of the kind
    "hanging", has the name of its parent and none of its conv_id.
    """

    def __init__(self, parts: bool):
        self.parts, self.held, self.open = parts, [], []
        self.stack, self.path, self.sizes = [Point(0)], None, []
        self.first, self.with_first, self.on_first = None, 0, []

    def sequence(self, path: bytes, sizes: list[int], given: list[tuple]) -> None:
        """The next sequence, and what is known of its prefixes, as in `open`."""
        if self.path is None:
            self.first, self.with_first = (path, sizes), len(path) // DIGEST
        else:
            common = shared(self.path, path)
            self.close(common)
            self.with_first = min(self.with_first, common)
        self.path, self.sizes = path, sizes
        for *part, ends in given:
            point = self.point(part[0])
            point.add(*part[1:])
            point.ends = point.ends if ends == NO_END else ends
            if not self.parts:
                point.name = prefix_name(path, point.depth)

    def point(self, depth: int) -> Point:
        """The point at a depth of the path at hand."""
        at = len(self.stack)
        while self.stack[at - 1].depth > depth:
            at -= 1
        if self.stack[at - 1].depth < depth:
            self.stack.insert(at, Point(depth))
            return self.stack[at]
        return self.stack[at - 1]

    def close(self, common: int) -> None:
        """Completes the points deeper than what the next sequence shares with the path at hand."""
        while self.stack[-1].depth > common:
            point = self.stack.pop()
            if self.stack[-1].depth < common:
                self.stack.append(Point(common))
            if self.parts and point.depth <= self.with_first:
                self.on_first.append(point)
                self.leave_open(point)
            else:
                self.complete(point, self.stack[-1])

    def complete(self, point: Point, parent: Point) -> None:
        """Hands a point's counts to its parent and expands the edges below the point."""
        edge = self.sizes[parent.depth : point.depth]
        self.count_itself(point)
        parent.add(point.n, point.first, 1, point.leaves, point.saved + (point.n - 1) * sum(edge[:-1]))
        parent.below.append((point, edge))

    def count_itself(self, point: Point) -> None:
        """What is below the point is complete: the point itself is counted, and the edges below are expanded."""
        point.leaves += not point.children
        point.saved += (point.n - 1) * self.sizes[point.depth - 1] if point.depth else 0
        for child, edge in point.below:
            self.expand(child, edge, "node", None, point.first)
        point.below = []

    def leave_open(self, point: Point) -> None:
        """What is complete below an open point gets its rows; their parent is named."""
        name = prefix_name(self.path, point.depth) if point.below else None
        for child, edge in point.below:
            self.expand(child, edge, "hanging", name, None)
        point.below = []

    def expand(self, point: Point, edge: list[int], kind: str, name: bytes | None, above: int | None) -> None:
        """Rows of the nodes on the edge to a complete point, from the point up; kind, name and parent of the top one."""
        saved, top = point.saved, point.depth - len(edge) + 1
        for depth in range(point.depth, top - 1, -1):
            is_end, is_top = depth == point.depth, depth == top
            node = (point.first, depth, above if is_top else point.first, point.n, point.children if is_end else 1, point.leaves, saved)
            own_name = point.name if is_end else None
            self.held.append((kind if is_top else "node", name if is_top and kind == "hanging" else own_name, node, point.ends if is_end else NO_END))
            saved += (point.n - 1) * edge[depth - top - 1] if depth > top else 0

    def end(self) -> None:
        """After the last sequence."""
        if self.path is None:
            return
        of = lambda points: [(p.depth, p.n, p.first, p.children, p.leaves, p.saved, p.ends) for p in points]
        if self.parts:
            for point in self.stack:
                self.leave_open(point)
            self.open = [(*self.first, of(self.on_first)), (self.path, self.sizes, of(self.stack))]
        else:
            self.close(0)
            root = self.stack[0]
            self.count_itself(root)
            self.held.append(("node", root.name, (root.first, 0, None, root.n, root.children, root.leaves, root.saved), root.ends))


def _batch(held: list[tuple], opened: list[tuple]) -> pa.RecordBatch:
    none = [None] * len(opened)
    columns = {"kind": pa.array([h[0] for h in held] + ["open"] * len(opened), pa.string()), "node": pa.array([h[1] for h in held] + none, pa.binary())}
    columns |= {c: pa.array([h[2][k] for h in held] + none, pa.int64()) for k, c in enumerate(NODE)}
    before = [None] * len(held)
    parts = pa.list_(pa.struct([*[(c, pa.int64()) for c in PART], ("ends", pa.string())]))
    columns |= {"ends_sha256": pa.array([h[3] for h in held] + none, pa.string()), "path": pa.array(before + [x[0] for x in opened], pa.binary()), "sizes": pa.array(before + [x[1] for x in opened], pa.list_(pa.int64()))}
    return pa.RecordBatch.from_pydict(columns | {"parts": pa.array(before + [[dict(zip((*PART, "ends"), p, strict=True)) for p in x[2]] for x in opened], parts)})


def nodes_of(rows: DataFrame, parts: bool) -> DataFrame:
    """Rows (path, sizes, parts), each partition's in order, to rows of ROWS, by the partition's `Range`."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Range(parts)
        for batch in batches:
            for row in batch.to_pylist():
                own.sequence(row["path"], row["sizes"], [tuple(p.values()) for p in row["parts"]])
                if len(own.held) >= SENT:
                    yield _batch(own.held, [])
                    own.held = []
        own.end()
        yield _batch(own.held, own.open)

    return rows.select("path", "sizes", "parts").mapInArrow(built, ROWS)


def trie(talks: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<key binary, bytes long>>) to the nodes of their prefixes.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each sequence
    of turns with which a conversation begins, the empty one included. conv_id is the smallest of the conversations
    that begin so, parent_conv_id that of the sequence less its last turn. saved_tokens sums, over the node and those
    below it, the bytes of the last text times the conversations beyond the first. ends_sha256 is of the ids of the
    conversations that end there. Without conversations there is no node.
    """
    ready_for_python(talks.sparkSession)
    with scratch(talks.sparkSession) as keep:
        end = F.struct(F.size("sizes").alias("depth"), "n", "first", *[F.lit(0).alias(c) for c in PART[3:]], "ends")
        once = written(distinct(talks), "trie-sequences").select("path", "sizes", F.array(end).cast(PARTS).alias("parts"))
        local = keep(written(nodes_of(once.repartitionByRange("path").sortWithinPartitions("path"), True), "trie-ranges"))
        whole = local.where("kind = 'open'").repartition(1).sortWithinPartitions("path")  # two rows a range
        whole = keep(written(nodes_of(whole, False), "trie-open"))
    named = whole.where("node IS NOT NULL").select("node", F.col("conv_id").alias("above"))
    hanging = local.where("kind = 'hanging'").join(of_checked_size(named), "node").withColumn("parent_conv_id", F.col("above"))
    result = [*NODE, "ends_sha256"]
    return local.where("kind = 'node'").select(*result).unionByName(hanging.select(*result)).unionByName(whole.select(*result))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the trie of the rebuilt conversations: see `sequences`, `rebuilt` and `trie`.

    A null role or text is empty; rows with a null conv_id don't take part; turns with one number stand in a fixed
    order, repeated rows are repeated turns. Texts of any length are named by their digest. A conversation's digests,
    not its texts, must fit into a task. Further columns don't take part; an empty frame gives an empty frame.
    """
    return trie(rebuilt(written(sequences(turns), "trie-talks")))


SQL = f"""
WITH {CRC_SQL},
t AS (
  SELECT conv_id, turn, coalesce(strlen(text), 0) AS bytes,
         substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, bytes) AS k FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, {crc_sql("hexed")} % 9 AS h
  FROM (SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS hexed FROM (SELECT DISTINCT conv_id FROM t)), crc_table),
r AS (
  SELECT c.conv_id, 0 AS part, k, key, bytes FROM c JOIN o ON o.conv_id = c.head AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, key, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
p AS (
  SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(key, '') OVER w AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         CASE WHEN depth > 0 THEN substr(prefix, 1, 32 * (depth - 1)) END AS parent
  FROM p GROUP BY prefix, depth),
k AS (SELECT parent AS prefix, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
b AS (
  SELECT substr(n.prefix, 1, 32 * up) AS prefix, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM n) n LEFT JOIN k ON k.prefix = n.prefix GROUP BY 1),
e AS (
  SELECT path AS prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(prefix, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, m.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n m ON m.prefix = n.parent LEFT JOIN k ON k.prefix = n.prefix
JOIN b ON b.prefix = n.prefix LEFT JOIN e ON e.prefix = n.prefix
"""
