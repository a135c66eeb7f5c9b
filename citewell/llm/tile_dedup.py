"""Near-duplicate vectors by int8 tile products with exact error bounds.

A vector of length one is x = s q + e: q are whole numbers of one byte, s is a
scale, and the length of e is known.  For two vectors

    |x.y - s t (q.r)|  <=  |s q| |f| + |e|,

so the product of two tiles of bytes leaves pairs that are surely below the
threshold, pairs that are surely at or above it, and few in between; only those
are computed in double precision.  Products of bytes are summed in single
precision over at most ``SLAB`` components, where they are exact.

Equal vectors are one class and compared once.  The classes are dealt into
tiles by a hash, and every pair of tiles is one group of bounded size, so a
class meets every other one once.  A tile gives each class's links as a number
and the tile's links as a spanning forest, never as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import components

THRESHOLD = 0.9
#: Classes of one tile (on average), rows of a tile that are multiplied at once, and components of an exact product.
TILE, ROWS, SLAB = 4096, 512, 1024
#: Tiles at least, so that few vectors are dealt over several tasks too.
TILES = 8
#: More than all rounding of lengths and products in double precision for vectors of 2**16 components.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; powers of two are taken out first, so nothing overflows and nothing is rounded by that."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, scale, length of the bytes' vector and length of what is left, of rows of length one."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((units - near) ** 2).sum(axis=1))


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(r)))
    for at in range(0, q.shape[1], SLAB):
        total += q[:, at : at + SLAB].astype(np.float32) @ r[:, at : at + SLAB].astype(np.float32).T
    return total


def linked(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of rows of a and b whose cosine reaches the threshold, some rows of a at a time."""
    x, y = unit(a), unit(b)
    (q, s, size, rest), (r, t, _, rest_b) = quantised(x), quantised(y)
    for at in range(0, len(a), ROWS):
        part = slice(at, at + ROWS)
        product = _products(q[part], r) * s[part, None] * t
        error = size[part, None] * rest_b + rest[part, None] + SLACK
        i, j = np.nonzero(product + error >= threshold)
        sure = product[i, j] - error[i, j] >= threshold
        for k in range(0, len(i), 1 << 18):  # few of them; copies of a pair's vectors stay small
            open_ = np.flatnonzero(~sure[k : k + (1 << 18)]) + k
            sure[open_] = np.einsum("nd,nd->n", x[at + i[open_]], y[j[open_]]) >= threshold
        yield at + i[sure], j[sure]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in place; a set's label is its smallest index."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


_VECTORS = "vec_id long, vector binary, single boolean, class binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's components as bytes, and a name for equal ones; null if it takes no part."""
    for batch in batches:
        out, names = [], []
        single = pa.types.is_float32(batch.column(1).type.value_type)
        for value in batch.column(1):
            held = None
            if value.is_valid and len(value.values) and value.values.null_count == 0:
                numbers = value.values.to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
                if np.isfinite(numbers).all() and numbers.any():
                    held = (numbers + 0).tobytes()  # -0.0 is 0.0
            out.append(held)
            names.append(held and hashlib.blake2b(held, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([single] * len(out), pa.bool_()), pa.array(names, pa.binary())], ["vec_id", "vector", "single", "class"])


def _tile_pair(threshold: float):
    kinds = pa.schema([("class", pa.binary()), ("n_links", pa.int64()), ("top", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        kind = np.float32 if table.column("single")[0].as_py() else np.float64
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(table.num_rows, -1).astype(np.float64)
        names, weight = table.column("class"), table.column("n").to_numpy()
        a, b, same = np.flatnonzero(first), np.flatnonzero(second), bool((first & second).any())
        label, count = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        if len(a) and len(b):
            for i, j in linked(vectors[a], vectors[b], threshold):
                i, j = a[i], b[j]
                other = i != j
                i, j = i[other], j[other]
                np.add.at(count, i, weight[j])
                if not same:
                    np.add.at(count, j, weight[i])
                joined(label, i, j)
        found = np.flatnonzero(count)
        top = [names[int(t)].as_py() if t != x else None for x, t in zip(found, label[found], strict=True)]
        return pa.Table.from_arrays([names.take(pa.array(found)).combine_chunks(), pa.array(count[found], pa.int64()), pa.array(top, pa.binary())], schema=kinds)

    return run


def near_vectors(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings(vec_id, embedding).

    Two rows are linked if their cosine is the threshold or more; n_links counts rows, copies included, and a
    component has the smallest vec_id that links reach.  Vectors that are null, empty, zero or hold a null or a
    component that isn't finite are linked with nothing, nor are vectors of different dimensions.  Of vectors with
    equal ids each row is one; a row without an id is counted, but names no component that has an id, and isn't kept.
    Extra columns are ignored; no rows give no rows.  The threshold is above 0.
    """
    kind = dict(embeddings.dtypes)["embedding"]
    wanted = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), wanted.alias("embedding")).mapInArrow(_vectors, _VECTORS)
    rows = scratch.write(spark, rows, "vectors")
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class", "vector", "single").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = scratch.write(spark, classes, "classes")
    tiles = max(TILES, -(-classes.count() // TILE))

    tile = F.pmod(F.xxhash64("class"), F.lit(tiles)).cast("int")
    pairs = classes.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = pairs.select(
        "class", "vector", "single", "n", F.length("vector").alias("size"), F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        (F.col("tile") <= F.col("other")).alias("first"), (F.col("tile") >= F.col("other")).alias("second"),
    )
    found = pairs.groupBy("low", "high", "size").applyInArrow(_tile_pair(threshold), "class binary, n_links long, top binary")
    found = scratch.write(spark, found, "links")

    joined_to = components(found.filter(F.col("top").isNotNull()).select(F.col("top").alias("a"), F.col("class").alias("b")))
    links = found.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    known = classes.select("class", "n", "least").join(links, "class", "left").join(joined_to.withColumnRenamed("node", "class"), "class", "left")
    known = scratch.write(spark, known.select("class", "least", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "known")
    least = known.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("lowest"))
    named = known.join(least, "component", "left").select("class", "n_links", F.coalesce("lowest", "least").alias("component_id"))
    taking = rows.filter(F.col("class").isNotNull()).select("vec_id", "class").join(named, "class").select("vec_id", "n_links", "component_id")
    rest = rows.filter(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return taking.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
v AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.n AS a, b.n AS b, b.vec_id FROM v a JOIN v b ON a.n <> b.n AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r AS (SELECT n, n AS reached FROM e UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT r.n, min(e.vec_id) AS component_id FROM r JOIN e ON e.n = r.reached GROUP BY r.n)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.n)::BIGINT AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept FROM e JOIN c USING (n)
"""
