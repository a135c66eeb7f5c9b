"""Tries of conversations' turns by adaptive radix trees.

A turn's id has a fixed width: the length of its text, big-endian, and a digest
of role and text.  A conversation is the bytes of its turns' ids, so a prefix of
turns is a prefix of bytes.  The distinct conversations are sorted over ranges;
each range is cut into segments, and each segment becomes a radix tree whose
nodes grow from 4 over 16 and 48 to 256 children and whose paths are compressed.
Only byte depths at whole turns are nodes of the result, also those within a
compressed path.

All figures of a node are sums over the sorted conversations, if each knows what
it shares with the one before: a node belongs to the first conversation that has
it.  So a node that several segments share, at most the path of one conversation
at each border, is added up from them, and a first turn that most
conversations have is one row from each segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: Bytes of a turn's id: those of the text's length, and those of the digest.
LENGTH, DIGEST = 4, 16
WIDTH = LENGTH + DIGEST
#: Bytes of distinct conversations that one tree holds.
SEGMENT = 4_000_000
#: Bytes of conversation ids that travel as one value.
IDS = 64_000


class Node:
    """A node of the tree: its compressed path, its children by their next byte, and the conversations that end here.

    Up to 4 and up to 16 children lie in parallel arrays; up to 48 in an array that 256 positions point into; more in one array of 256.
    """

    __slots__ = ("index", "keys", "kids", "least", "path", "times")

    def __init__(self, path: bytes) -> None:
        self.path, self.keys, self.kids, self.index = path, bytearray(), [], None
        self.times, self.least = 0, None

    def layout(self) -> int:
        return 256 if self.keys is None else 48 if self.index is not None else 16 if len(self.keys) > 4 else 4

    def child(self, byte: int) -> Node | None:
        if self.keys is None:
            return self.kids[byte]
        if self.index is not None:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces a child; a full layout becomes the next larger one."""
        if self.keys is None:
            self.kids[byte] = kid
            return
        at = self.index[byte] - 1 if self.index is not None else self.keys.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return
        if len(self.kids) == 48:
            wide: list[Node | None] = [None] * 256
            for b, k in zip(self.keys, self.kids, strict=True):
                wide[b] = k
            wide[byte] = kid
            self.keys, self.index, self.kids = None, None, wide
            return
        self.keys.append(byte)
        self.kids.append(kid)
        if self.index is not None:
            self.index[byte] = len(self.kids)
        elif len(self.kids) == 17:
            self.index = bytearray(256)
            for i, b in enumerate(self.keys):
                self.index[b] = i + 1

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.keys is None:
            return [k for k in self.kids if k]
        return [k for _, k in sorted(zip(self.keys, self.kids, strict=True), key=lambda x: x[0])]


def common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    """Adaptive radix tree over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def add(self, key: bytes, times: int, least: int | None) -> None:
        above, at, here = None, 0, self.root
        while True:
            same = common(here.path, key[at : at + len(here.path)])
            if same < len(here.path):  # the path splits
                upper = Node(here.path[:same])
                here.path, byte = here.path[same:], here.path[same]
                upper.put(byte, here)
                above.put(upper.path[0], upper)
                here = upper
            at += same
            if at == len(key):
                here.times += times
                here.least = min((x for x in (here.least, least) if x is not None), default=None)
                return
            kid = here.child(key[at])
            if kid is None:
                kid = Node(key[at:])
                kid.times, kid.least = times, least
                here.put(key[at], kid)
                return
            above, here = here, kid


_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, node binary, parent binary, shared boolean, ends boolean"
_NODE_KINDS = [*[pa.int64()] * 7, pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]


def _name(prefix: bytes) -> bytes:
    return hashlib.md5(prefix).digest()


def segment_nodes(keys: list[tuple[bytes, int, int | None]], before: bytes | None, after: bytes | None) -> list[tuple]:
    """Rows of _NODE for the trie of sorted distinct keys (key, conversations, smallest of them), the key before and the one after.

    A node that the key before or the key after has too is marked as shared, and counts only what begins in this segment.
    """
    tree = RadixTree()
    for key, times, least in keys:
        tree.add(key, times, least)
    first, last = keys[0][0], keys[-1][0]
    old = -1 if before is None else common(before, first)  # up to this depth the first path began before
    open_ = -1 if after is None else common(last, after)  # up to this depth the last path goes on

    out: list[list] = []

    def emit(prefix: bytes, total: list, kids: list, on_first: bool, on_last: bool, here: Node | None) -> list:
        """A node at a whole turn; total: conversations, smallest, leaves, saved below it; kids: rows of its children in this segment."""
        depth = len(prefix)
        begun, goes_on = on_first and depth <= old, on_last and depth <= open_
        shared = begun or goes_on
        n_convs, least, leaves, saved = total
        new_kids = len(kids) - (begun and bool(kids) and kids[0][11])
        leaf = not kids and not (on_last and open_ == depth)  # the key after may go on from here
        saved += (n_convs - (not begun)) * (int.from_bytes(prefix[depth - WIDTH : depth - DIGEST], "big") if depth else 0)
        ends = here is not None and here.times > 0
        row = [least, depth // WIDTH, n_convs, new_kids, leaves + leaf, saved, None, _name(prefix) if shared or ends else None, None, shared, ends, begun]
        for kid in kids:
            if shared:
                kid[8] = row[7]
            else:
                kid[6] = least
        if depth and shared:
            row[8] = b""  # filled in by its parent, which is shared too
        out.append(row)
        return row

    # post-order: each frame has a node, the depth before its path, its children still to do, and what is known of those done
    def frame(node: Node, prefix: bytes, on_first: bool, on_last: bool) -> list:
        kids = node.children()
        return [node, prefix, on_first, on_last, iter(kids), len(kids), [node.times, node.least, 0, 0], []]

    stack, result = [frame(tree.root, b"", True, True)], None
    while stack:
        node, prefix, on_first, on_last, rest, n, total, kids = stack[-1]
        full = prefix + node.path
        if result is not None:
            done, rows = result
            total[0] += done[0]
            total[1] = min((x for x in (total[1], done[1]) if x is not None), default=None)
            total[2] += done[2]
            total[3] += done[3]
            kids += rows
            result = None
        if (kid := next(rest, None)) is not None:
            stack.append(frame(kid, full, on_first and first.startswith(full + kid.path), on_last and last.startswith(full + kid.path)))
            continue
        stack.pop()
        low, depth = len(prefix), len(full)
        # a path that the first or last key leaves within is on it only as far as both go together
        for d in range(depth - depth % WIDTH, low if low or stack else -1, -WIDTH):
            part = full[:d]
            row = emit(part, total, kids, first.startswith(part), last.startswith(part), node if d == depth else None)
            total, kids = [row[2], row[0], row[4], row[5]], [row]
        result = (total, kids)
    return [tuple(r[:11]) for r in out]


# tables


def _turn_id() -> Column:
    """The id as hexadecimal digits."""
    said = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256)
    return F.concat(F.lpad(F.hex(F.length("text")), 2 * LENGTH, "0"), F.substring(said, 1, 2 * DIGEST))


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, ids: hexadecimal turn ids in order of turn (null first), then role and text; null roles and texts are empty."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).select("conv_id", "n", _turn_id().alias("id"))
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).getField("id").alias("ids"))


def rebuilt(known: DataFrame) -> DataFrame:
    """conv_id, key: the first h turns of conversation c - c % 100, then its own turns after its first h; h is crc32(c) % 6.

    Without a conv_id, h is that of an empty name, and the head comes from nowhere.
    """
    h = (F.crc32(F.encode(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "utf-8")) % 6).cast("int")
    heads = known.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head"))
    rows = known.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    met = rows.join(heads, "base", "left")
    ids = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("ids", F.col("h") + 1, F.size("ids")))
    return met.select("conv_id", F.unhex(F.array_join(ids, "")).alias("key"))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("times"), F.min("conv_id").alias("least"))


def _borders(spark: SparkSession, keys: DataFrame):
    """Broadcast: the last key before each range and the first one after it; two keys for each range pass the driver."""
    ends = keys.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    ends.sort(key=lambda r: r.range)
    found = {}
    for i, r in enumerate(ends):
        found[r.range] = (bytes(ends[i - 1].last) if i else None, bytes(ends[i + 1].first) if i + 1 < len(ends) else None)
    return spark.sparkContext.broadcast(found)


def trie(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """The nodes of the trie of pairs (conv_id, key), with ``node`` and ``ends`` where conversations end.

    Keys are whole numbers of turns.  Equal keys are counted before they are dealt out.
    """
    keys = _distinct(pairs).repartitionByRange("key").withColumn("range", F.spark_partition_id())
    keys = scratch.write(spark, keys, "keys")
    borders = _borders(spark, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made(held: list, before: bytes | None, after: bytes | None) -> Iterator[pa.RecordBatch]:
            found = segment_nodes(held, before, after)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], k) for c, k in enumerate(_NODE_KINDS)], [x.split()[0] for x in _NODE.split(", ")])

        held, size, before, now = [], 0, None, None
        for where, key, times, least in rows():
            if where != now:
                if held:
                    yield from made(held, before, borders.value[now][1])
                held, size, before, now = [], 0, borders.value[where][0], where
            elif size >= SEGMENT:
                yield from made(held, before, key)
                before, held, size = held[-1][0], [], 0
            held.append((key, times, least))
            size += len(key) + WIDTH
        if held:
            yield from made(held, before, borders.value[now][1])

    nodes = keys.repartition("range").sortWithinPartitions("range", "key").select("range", "key", "times", "least").mapInArrow(run, _NODE)
    nodes = scratch.write(spark, nodes, "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    one = [F.first("depth").alias("depth"), F.max("parent").alias("parent"), F.max("ends").alias("ends")]
    shared = scratch.write(spark, nodes.filter("shared").groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *one), "shared")
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "node", "ends"]
    below = nodes.filter("NOT shared AND parent IS NOT NULL").select(*columns, "parent").unionByName(shared.filter("parent IS NOT NULL").select(*columns, "parent"))
    root = shared.filter("parent IS NULL").select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    alone = nodes.filter("NOT shared AND parent IS NULL").select(*columns, "parent_conv_id")
    met = below.join(above, "parent").select(*columns, F.col("above").alias("parent_conv_id"))
    return alone.unionByName(met).unionByName(root)


def end_digests(pairs: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids, in order and joined by commas, of the conversations that end at a node.

    Ids come together over ranges of (node, conv_id) first, so that of a very common conversation each range sends a few long values.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["node", "first", "ids"])

        for got in batches:
            for name, conv in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if ids and (name != node or size > IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node = name
                ids.append(conv)
                size += 12
            if len(out) >= 1000:
                yield batch()
                out = []
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
        if out:
            yield batch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for got in batches:
            for name, ids in zip(*(c.to_pylist() for c in got.columns), strict=True):
                if name != node:
                    out += [(node, sha.hexdigest())] if sha else []
                    node, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        out += [(node, sha.hexdigest())] if sha else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["node", "ends_sha256"])

    ends = pairs.filter("conv_id IS NOT NULL").select(F.unhex(F.md5("key")).alias("node"), "conv_id")
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node binary, first long, ids string")
    return ranged.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations(conv_id, turn, role, text), from the root.

    Turns go by number, null first, then role and text; repeated rows are turns of their own; null roles and texts are
    empty.  Rows without a conv_id are one conversation, a member without a number: it is counted, but is nobody's
    smallest member and in no digest.  Extra columns are ignored; no rows give no nodes.  A conversation is one key,
    WIDTH bytes a turn, and has to fit a task.
    """
    pairs = scratch.write(spark, rebuilt(turn_ids(conversations)), "rebuilt")
    nodes, ends = trie(spark, pairs), end_digests(pairs)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    with_ends = nodes.filter("ends").join(ends, "node", "left")
    empty = F.sha2(F.lit(b""), 256)
    return with_ends.select(*columns, F.coalesce("ends_sha256", empty).alias("ends_sha256")).unionByName(nodes.filter("NOT ends").select(*columns, empty.alias("ends_sha256")))


SQL = r"""
WITH o AS (SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations),
k AS (SELECT conv_id, list(t ORDER BY n) AS ts FROM o GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 6 AS h FROM k),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN k b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT r.conv_id, d, ts[1:d] AS path, len(ts) = d AS ends, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars FROM r, unnest(range(0, len(ts) + 1)) AS u(d)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
c AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.path[1:n.d] = n.path) AS n_children FROM n),
s AS (SELECT a.path AS path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM c a JOIN c b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM c JOIN s ON s.path = c.path LEFT JOIN n u ON u.d = c.d - 1 AND u.path = c.path[1:c.d - 1]
"""
