"""Exact Jaccard join on word shingles by vertical partitioning.

The shingles have one global order, rarest first: by the magnitude of their
document count (blocks.global_counts), then by fingerprint.  Pivots in that
order cut it into fragments.  The overlap of a pair is counted in each fragment
by itself and summed per pair; shingles of one document overlap with nothing
and are left out.

Texts with equal sets form a class and are compared once.  Two classes can only
be linked if they share a shingle among the first n - ceil(t n) + 1 of their
orders.  Pairs under such a shingle are taken in two rounds: first each class
with the group's most ordinary class, then, with the links found so far
contracted, the pairs that lie in different components and whose sizes and
places allow a link: those are joined by size and place.  So a group of
thousands of near copies costs a star, thousands of unlike texts under one
shingle cost nothing, and no link that could join two components is left untested.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, kernel, scratch
from .components import components

SHINGLE = 5
#: The threshold as a fraction: NUM / DEN of the union.
NUM, DEN = 80, 100
#: Pivots of the global order: a fragment holds the shingles of PIVOTS[i] documents or more, up to the next pivot.
PIVOTS = (2, 4, 8, 32)
#: Rows of keys (some 40 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of one class, or links of one node, from which on they are dealt over several tasks.
HOT = 1000

_PROFILE = "doc_id long, n long, class binary, block long, rare long, keys array<struct<key:long,pos:int>>, parts array<array<long>>"


def _sets(block: blocks.Block) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in block:
        starts, ends, first = kernel.spans(data, offsets, kernel.NO_SPACE)
        out += kernel.shingle_sets(kernel.word_hashes(data, starts, ends, True), first, SHINGLE)
    return out


def _distinct(block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_sets(block)]), return_counts=True)


def _profile(block: blocks.Block, counts: np.ndarray) -> pa.Table:
    """Each document's size and class; of a class's first document in the block also its prefix and its set by fragment."""
    sets = _sets(block)
    values = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
    sizes, classes, rare, key_rows, set_rows, seen = [], [], [], [], [], set()
    for mine in sets:
        n = len(mine)
        name = hashlib.blake2b(mine.tobytes(), digest_size=16).digest()
        sizes.append(n)
        classes.append(name)
        keys, parts, alone = None, None, 0
        if n and name not in seen:
            seen.add(name)
            found = counts[np.searchsorted(values, mine)]
            alone = int((found < 2).sum())
            order = np.lexsort((mine, np.frexp(found.astype(np.float64))[1]))[: n + 1 - -(-NUM * n // DEN)]
            shared = np.flatnonzero(found[order] > 1)
            if len(shared):
                keys = [{"key": k, "pos": p} for k, p in zip(mine[order[shared]].view(np.int64).tolist(), shared.tolist(), strict=True)]
                fragment = np.searchsorted(PIVOTS, found, side="right")  # 0: of one document
                parts = [mine[fragment == f].view(np.int64) for f in range(1, len(PIVOTS) + 1)]
        rare.append(alone)
        key_rows.append(keys)
        set_rows.append(parts)
    return pa.Table.from_arrays(
        [
            block.ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array([block.number] * len(sets), pa.int64()), pa.array(rare, pa.int64()),
            pa.array(key_rows, pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())]))), pa.array(set_rows, pa.list_(pa.list_(pa.int64()))),
        ],
        ["doc_id", "n", "class", "block", "rare", "keys", "parts"],
    )


def _possible(a: str, b: str) -> Column:
    """Sizes and places allow the threshold, if the shared key is the first one of both orders."""
    least = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return least * (NUM + DEN) >= NUM * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _edge(a: str, b: str) -> list[Column]:
    """The pair with the smaller class first."""
    first = F.col(f"{a}.class") < F.col(f"{b}.class")
    pick = lambda x, y, c: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return [pick(a, b, "class").alias("a"), pick(b, a, "class").alias("b"), (F.col(f"{a}.n") + F.col(f"{b}.n")).alias("sum")]


def _sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def verified(spark: SparkSession, profile: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (a, b, sum of sizes) at or above the threshold: partial overlaps by fragment, added up.

    The edges of a node with many of them are dealt over salts, and its set is copied to each salt.
    """
    ends = edges.select(F.col("a").alias("class")).unionByName(edges.select(F.col("b").alias("class"))).distinct()
    held = profile.filter(F.col("parts").isNotNull())
    wanted = _sized(held.select("class", "block").join(ends, "class", "left_semi").groupBy("class").agg(F.min("block").alias("block")))
    sets = held.select("class", "block", "parts").join(wanted, ["class", "block"]).select("class", F.posexplode("parts").alias("fragment", "part")).filter(F.size("part") > 0)
    for end, other in (("a", "b"), ("b", "a")):
        hubs = edges.groupBy(end).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(end, F.ceil(F.col("n") / HOT).cast("int").alias(f"salts_{end}"))
        hubs = _sized(scratch.write(spark, hubs, "hubs"))
        edges = edges.join(hubs, end, "left").withColumn(f"salt_{end}", F.pmod(F.xxhash64(other), F.coalesce(f"salts_{end}", F.lit(1))).cast("int")).drop(f"salts_{end}")
        mine = sets.withColumnsRenamed({"class": end, "part": f"part_{end}"}).join(hubs, end, "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"salts_{end}", F.lit(1)) - 1)).alias(f"salt_{end}")
        edges = edges.join(mine.select(end, "fragment", f"part_{end}", copies), [end, f"salt_{end}", *(["fragment"] if end == "b" else [])])
    partial = edges.select("a", "b", "sum", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b", "sum").agg(F.sum("overlap").alias("overlap"))
    return total.filter(F.col("overlap") * (NUM + DEN) >= NUM * F.col("sum")).select("a", "b")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs (x, y) of different labels under one key that sizes and places allow: y is not of the key's main label."""
    places = mixed.select("key", F.col("x.n").alias("n"), F.col("x.pos").alias("pos")).distinct()
    x, y = places.select("key", F.struct("n", "pos").alias("x")), places.select("key", F.struct("n", "pos").alias("y"))
    allowed = x.join(y, "key").filter(_possible("x", "y")).select("key", F.col("x").alias("at_x"), F.col("y").alias("at_y"))
    at = lambda c: F.struct(F.col(f"{c}.n").alias("n"), F.col(f"{c}.pos").alias("pos")).alias(f"at_{c}")
    fewer = mixed.filter(F.col("label") != F.col("main")).select("key", F.col("x").alias("y")).select("key", at("y"), "y")
    pairs = mixed.select("key", at("x"), "main", "x").join(allowed, ["key", "at_x"]).join(fewer, ["key", "at_y"])
    return pairs.filter((F.col("x.label") != F.col("y.label")) & ((F.col("x.label") == F.col("main")) | (F.col("x.class") < F.col("y.class"))))


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (doc_id, n_shingles, class) with their class's ``known``: classes of many rows by broadcast, so no task gets all copies of a text.

    Rows without a class, or of a class that was found by broadcast, meet nothing in the second join, each under a key of its own.
    """
    hot = _sized(rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("class").join(known, "class").withColumnRenamed("known", "hot"))
    rows = rows.join(hot, "class", "left")
    alone = F.encode(F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "utf-8")
    rows = rows.withColumn("class", F.when(F.col("hot").isNull() & F.col("class").isNotNull(), F.col("class")).otherwise(alone))
    return rows.join(known, "class", "left").select("doc_id", "n_shingles", F.coalesce("hot", "known", "doc_id").alias("component_id"))


def near_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents(doc_id, text).

    Links are all pairs of sets with 100 |x & y| >= 80 |x | y|; a component has the smallest doc_id that links
    reach.  Null, empty and blank texts have no shingles and are linked with nothing, copies of them included.
    Repeated rows are repeated; extra columns are ignored; an empty table gives no rows.
    """
    made = blocks.blocks(spark, docs)
    total = made.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    counts = blocks.global_counts(made, _distinct, blocks.ranges_for(total // 6))
    profile = scratch.write(spark, blocks.with_counts(made, counts, _profile, _PROFILE), "profile")
    scratch.drop(spark, made)

    postings = profile.filter(F.col("keys").isNotNull()).select("class", "n", "rare", F.explode("keys").alias("k")).select("k.key", "class", "n", "rare", "k.pos")
    postings = scratch.write(spark, postings.distinct(), "postings")
    member = F.struct("class", "n", "pos")
    centre = postings.groupBy("key").agg(F.min_by(member, F.struct("rare", "class")).alias("x"), F.count("*").alias("size")).filter(F.col("size") > 1)
    star = postings.select("key", member.alias("y")).join(centre, "key").filter((F.col("x.class") != F.col("y.class")) & _possible("x", "y")).select(*_edge("x", "y")).distinct()
    star = scratch.write(spark, star, "star")
    links = scratch.write(spark, verified(spark, profile, star), "links")

    labels = components(links)
    marked = postings.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class")).select("key", "label", F.struct("class", "n", "pos", F.coalesce("component", "class").alias("label")).alias("x"))
    sizes = marked.groupBy("key", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).filter(F.col("labels") > 1).drop("labels")
    mixed = scratch.write(spark, marked.join(mixed, "key"), "mixed")
    rest = _across(mixed).select(*_edge("x", "y")).distinct().join(star, ["a", "b"], "left_anti")
    rest = scratch.write(spark, rest, "rest")
    more = scratch.write(spark, verified(spark, profile, rest), "links")

    named = profile.filter(F.col("n") > 0).groupBy("class").agg(F.min("doc_id").alias("least"))
    joined = components(links.unionByName(more))
    least = joined.join(named.withColumnRenamed("class", "node"), "node").groupBy("component").agg(F.min("least").alias("lowest"))
    reached = joined.join(least, "component").select(F.col("node").alias("class"), "lowest")
    known = named.join(reached, "class", "left").select("class", F.coalesce("lowest", "least").alias("known"))
    known = scratch.write(spark, known, "known")
    rows = profile.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    for done in (postings, star, links, mixed, rest, more):
        scratch.drop(spark, done)
    return _named(rows, known)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS least_id FROM r GROUP BY 1) USING (doc_id)
"""
