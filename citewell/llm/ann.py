"""Approximate nearest neighbours by adaptive dimension scans.

Vectors are extended by one component that makes largest inner product the same
as smallest distance, then rotated at random and held by column blocks in
inverted lists around k-means centroids.  Within each probed list a query adds
up partial distances block by block; after each block a hypothesis test drops
the candidates whose full distance is, at the chosen confidence, beyond the
k-th best seen.  A query's nearest lists are scanned first; the k-th best found
there bounds the scans of its other lists, each of which tightens it further.
Survivors are ranked by the exact inner product of the original vectors.

The lists stay where they are written and queries come to them, broadcast in
blocks: a task holds one block and its best k, whatever number of lists it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: Rows that fit the centroids, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Lists, at most, and rows of a list that are aimed at; longer lists are scanned in pieces of CHUNK rows.
LISTS, PER_LIST, CHUNK = 1024, 512, 4096
#: Bytes of the vectors of a block of queries, in double precision; pairs of a query and a list that are held at once.
QUERY_BYTES, HELD = 8_000_000, 1 << 21
#: Share of the lists that a query probes, besides one more; and the test's confidence.
PROBES, EPSILON = 0.7, 1.2
#: Dimensions of a block, and rows of a list between two updates of the bounds.
COLUMNS, SLAB = 16, 1024
#: A query's first lists hold this many times k rows.
SPARE = 20


def _clean(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    present = typed.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return present.filter(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


class Space:
    """Extension, rotation and centroids, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, bound: float, lists: int):
        rng = np.random.default_rng(7)
        self.bound = bound
        size = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        lists = min(lists, len(sample))
        points = self.extended(sample)
        centres = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(12):
            near = self._near(points, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            counts = np.bincount(near, minlength=lists)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = np.unique(centres, axis=0)

    @staticmethod
    def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        norms, rows = (centres * centres).sum(axis=1), max(1, HELD // len(centres))
        parts = [np.argmin(norms - 2 * points[a : a + rows] @ centres.T, axis=1) for a in range(0, len(points), rows)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def extended(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0.0, self.bound - (x * x).sum(axis=1)))
        return np.hstack([x, last[:, None]]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Queries scaled to the data's norm, which leaves their order of candidates alone."""
        unit = x * np.sqrt(self.bound / (x * x).sum(axis=1))[:, None]
        return np.hstack([unit, np.zeros((len(x), 1))]) @ self.rotation

    def limits(self, x: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Squared distances of the scaled queries at which a row has these inner products with them; nan: no limit."""
        out = 2 * self.bound - 2 * np.sqrt(self.bound / (x * x).sum(axis=1)) * inner
        return np.where(np.isnan(out), np.inf, out) + 1e-9 * self.bound + 1e-12

    def lists(self, points: np.ndarray) -> np.ndarray:
        return self._near(points, self.centres)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To all centroids, less what depends on the point alone."""
        return (self.centres * self.centres).sum(axis=1) - 2 * points @ self.centres.T

    def radii(self, points: np.ndarray, held: np.ndarray, enough: int, least: int) -> np.ndarray:
        """Two of these distances for each point: its first lists lie within the first, all that it probes within the second.

        The first lists are the nearest ones that hold more than ``enough`` rows together, ``held`` of each list; at
        least ``least`` lists are probed.  A radius lies halfway to the next list, so that rounding moves none.
        """
        count, out = len(self.centres), []
        rows = max(1, HELD // count)
        for a in range(0, len(points), rows):
            distance = self.distances(points[a : a + rows])
            order = np.argsort(distance, axis=1)
            distance = np.take_along_axis(distance, order, axis=1)
            first = np.minimum(1 + (np.cumsum(held[order], axis=1) <= enough).sum(axis=1), count)
            ends = np.append(distance, np.full((len(order), 1), np.inf), axis=1)
            at = np.arange(len(order))
            halfway = lambda n: np.where(n < count, (ends[at, n - 1] + ends[at, np.minimum(n, count)]) / 2, np.inf)  # noqa: B023, E731
            out.append(np.stack([halfway(first), halfway(np.maximum(first, least))], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64, copy=False)


class Best:
    """The best k found of each query of a block, each id by its best row, and the distances that bound what may still come."""

    def __init__(self, space: Space, originals: np.ndarray, inner: np.ndarray, k: int):
        self.space, self.originals, self.k = space, originals, k
        self.limits = space.limits(originals, inner)
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.new.append((q, ids, score))
        self.waiting += len(q)
        if self.waiting > max(1 << 16, len(self.originals) * self.k):
            self.settle()

    def settle(self) -> None:
        q, ids, score = (np.concatenate([a, *(x[i] for x in self.new)]) for i, a in enumerate(self.found))
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))[: len(q)]
        q, ids, score = q[once], ids[once], score[once]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        inner = np.full(len(self.originals), np.nan)
        inner[q[last]] = score[last]
        self.limits = np.minimum(self.limits, self.space.limits(self.originals, inner))
        kept = place < self.k
        self.found, self.new, self.waiting = [q[kept], ids[kept], score[kept]], [], 0


def _scan(rotated: np.ndarray, queries: np.ndarray, limits: np.ndarray, own: np.ndarray, k: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no test drops.  ``rotated`` has a row for each dimension; ``limits`` bound the k-th distance.

    ``own`` marks pairs that do not count.  After each slab of rows the bounds fall to the k-th best seen by then, if
    the rows have ``distinct`` ids: rows of one id are one neighbour.
    """
    best, limits, found = np.full((len(queries), k), np.inf), limits.copy(), []
    for at in range(0, rotated.shape[1], SLAB):
        part = rotated[:, at : at + SLAB]
        q, c, distance = _tested(part, queries, limits)
        other = ~own[q, at + c]
        q, c, distance = q[other], c[other], distance[other]
        found.append((q, at + c))
        if not distinct:
            continue
        seen = np.full((len(queries), k + part.shape[1]), np.inf)
        seen[:, :k] = best
        seen[q, k + c] = distance
        best = np.partition(seen, k - 1, axis=1)[:, :k]
        limits = np.minimum(limits, best[:, k - 1] * (1 + 1e-9) + 1e-12)
    return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])


def _tested(rotated: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the pairs that pass all tests.

    The first blocks are matrix products over all pairs; once a test has thinned them out, blocks are added pair by pair.
    """
    size, norms = rotated.shape[0], rotated * rotated
    partial = np.zeros((len(queries), rotated.shape[1]))
    q = c = kept = None
    for a in range(0, size, COLUMNS):
        b = min(a + COLUMNS, size)
        if q is None:
            part = queries[:, a:b]
            partial += (part * part).sum(axis=1)[:, None] + norms[a:b].sum(axis=0) - 2 * part @ rotated[a:b]
        else:
            kept += ((rotated[a:b, c] - queries[q, a:b].T) ** 2).sum(axis=0)
        slack = limits * ((1 + EPSILON / np.sqrt(b)) ** 2 * b / size if b < size else 1 + 1e-9)
        if q is None:
            alive = partial <= slack[:, None]
            if b == size or 4 * np.count_nonzero(alive) < alive.size:
                q, c = np.nonzero(alive)
                kept = partial[q, c]
        else:
            alive = kept <= slack[q]
            q, c, kept = q[alive], c[alive], kept[alive]
    return q, c, kept


def search(spark: SparkSession, rows: DataFrame, query_divisor: int = 20, k: int = 20, probes: float = PROBES, per_list: int = PER_LIST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, ties to the smaller id.

    Queries are the rows whose vec_id is a multiple of the divisor; candidates are all other rows.  Vectors that
    are null, empty, all zero, or hold a null or non-finite component take no part, nor do vectors of another
    length than the commonest (of equally common ones the shortest).  An id is found once, by its best row; a query
    whose id has several vectors asks with the smallest.  Extra columns are ignored; no rows give no results.
    """
    clean = _clean(rows)
    sizes = clean.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = usual["size"], usual["n"]
    clean = clean.filter(F.size("embedding") == size)
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    bound = clean.agg(F.max(square)).first()[0]
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    lists = max(1, min(total // per_list, LISTS))
    space = spark.sparkContext.broadcast(Space(_matrix(sample.column(0), size), bound, lists))

    kind = dict(clean.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            points = s.extended(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.lists(points), pa.int32())], ["vec_id", "embedding", "list"])

    placed = clean.mapInArrow(place, f"vec_id long, embedding {kind}, list int").hint("rebalance", F.col("list"))
    index = scratch.write(spark, placed.sortWithinPartitions("list"), "vectors")
    held = np.zeros(len(space.value.centres), np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # LISTS rows at most
        held[r.list] = r.n
    least = min(len(held), 1 + math.ceil(probes * len(held)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in batches:
            radii = s.radii(s.queries(_matrix(batch.column(1), size)), held, SPARE * k, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radii[:, 0]), pa.array(radii[:, 1])], ["query_id", "embedding", "near", "far"])

    asked = clean.filter(F.col("vec_id") % query_divisor == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = scratch.write(spark, asked.mapInArrow(reach, f"query_id long, embedding {kind}, near double, far double"), "asked")
    blocks = max(1, -(-asked.count() * size * 8 // QUERY_BYTES))
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place_of)

    def found_for(queries: DataFrame, after: bool) -> DataFrame:
        """A block's best k of each task in the first lists of its queries, or in those after them that are probed."""
        block = queries.toArrow()
        shared = spark.sparkContext.broadcast((
            block.column("query_id").to_numpy(), _matrix(block.column("embedding"), size),
            block.column("near").to_numpy(), block.column("far").to_numpy(), block.column("inner").to_numpy(zero_copy_only=False).astype(np.float64),
        ))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = space.value
            names, originals, near, far, inner = shared.value
            best, turned = Best(s, originals, inner, k), s.queries(originals)
            for batch in batches:
                lists = batch.column("list").to_numpy()
                cuts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else []
                for start, end in zip(cuts, [*cuts[1:], len(lists)], strict=True):
                    centre = s.centres[lists[start]]
                    distance = (centre * centre).sum() - 2 * turned @ centre
                    probing = np.flatnonzero((distance > near) & (distance <= far) if after else distance <= near)
                    for a in range(start, end if len(probing) else start, CHUNK):
                        part = batch.slice(a, min(CHUNK, end - a))
                        exact, ids = _matrix(part.column("embedding"), size), part.column("vec_id").to_numpy()
                        rotated = np.ascontiguousarray(s.extended(exact).T)  # a row for each dimension: column blocks
                        distinct = len(np.unique(ids)) == len(ids)
                        for at in range(0, len(probing), 128):
                            these = probing[at : at + 128]
                            q, c = _scan(rotated, turned[these], best.limits[these], ids[None, :] == names[these, None], k, distinct)
                            q = these[q]
                            score = np.concatenate([np.empty(0), *((exact[c[i : i + 65536]] * originals[q[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536))])
                            best.add(q, ids[c], score)
            best.settle()
            q, ids, score = best.found
            for a in range(0, len(q), 65536):
                part = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(names[q[part]], pa.int64()), pa.array(ids[part], pa.int64()), pa.array(score[part])], ["query_id", "vec_id", "score"])

        found = scratch.write(spark, index.mapInArrow(scan, "query_id long, vec_id long, score double"), "neighbours")
        shared.unpersist()
        return found

    out = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        first = found_for(mine.withColumn("inner", F.lit(None).cast("double")), False)
        kth = once(first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("inner"))
        both = first.unionByName(found_for(mine.join(kth, "query_id", "left"), True))
        out = both if out is None else out.unionByName(both)
    return once(out).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
