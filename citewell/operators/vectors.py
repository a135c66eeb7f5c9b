"""Cosines of vectors with a broadcast set of queries, as matrix products over the rows of a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows and queries of a product.
TILE = 2048
#: More than half of the last digit that a score is rounded to.
MARGIN = 1e-6


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and vectors of length 1.  Empty, zero and vectors with a null are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    starts, values = np.cumsum(sizes) - sizes, flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.add.reduceat(np.append(flat.is_null().to_numpy(zero_copy_only=False), False).astype(np.int64), starts) > 0 if len(starts) else np.empty(0, bool)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == size) & ~bad)
        rows = values[starts[at][:, None] + np.arange(size)]
        with np.errstate(all="ignore"):
            square = (rows * rows).sum(axis=1)
            some = ~(square <= 0)
            out[size] = at[some], rows[some] / np.sqrt(square[some])[:, None]
    return out


class _Best:
    """The best rows of each query that a task has met: by score, then id."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.bound = limit, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(1 << 18, 2 * queries * limit)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((q, ids, score))
        self.waiting += len(q)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        q, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        high = np.where(np.isnan(score), np.inf, score)  # as Spark orders them
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -high, q))
        q, ids, score, high = q[order], ids[order], score[order], high[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.limit - 1
        self.bound[q[last]] = high[last]
        kept = place < self.limit
        self.parts, self.waiting = [(q[kept], ids[kept], score[kept])], 0
        return self.parts[0]


def _tile(wanted: np.ndarray, held: np.ndarray, a: int, b: int, bound: np.ndarray, limit: int, own: np.ndarray, rows: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the pairs of a tile that may be among the best; ``own`` are places (row, query) that do not count."""
    with np.errstate(all="ignore"):
        near = wanted[b : b + TILE] @ held[a : a + TILE].T
        mine = own[np.isin(own[:, 0], rows[a : a + TILE]) & np.isin(own[:, 1], where[b : b + TILE])]
        near[np.searchsorted(where[b : b + TILE], mine[:, 1]), np.searchsorted(rows[a : a + TILE], mine[:, 0])] = -np.inf
        open_ = ~(near < np.maximum(bound - MARGIN, 0.0)[:, None])
        if near.shape[1] > limit and np.count_nonzero(open_) > 4 * limit * len(near):
            open_ &= ~(near < np.partition(near, -limit, axis=1)[:, -limit, None] - MARGIN)
        q, c = np.nonzero(open_)
        q, c = b + q, a + c
        # summed pair by pair: the same for equal vectors, wherever they stand in a tile
        score = np.concatenate([np.empty(0), *((wanted[q[i : i + 65536]] * held[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536))])
        score = np.floor(score * 1e6 + 0.5) / 1e6
    kept = ~(score <= 0)
    return q[kept], c[kept], score[kept]


def nearest(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, score: each task's best rows of chunks(chunk_id, vector) for each of queries(query_id, query_vector).

    Scores are cosines above 0, rounded to six decimals; a vector of another length has none, nor has a query with itself.
    Queries are broadcast, so they are a block of bounded size; a task holds them, a tile of scores and its best rows.
    """
    asked = queries.select("query_id", F.col("query_id").cast("string").alias("name"), "query_vector").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((asked.column("query_id").to_numpy(), asked.column("name").to_pylist(), _units(asked.column("query_vector"))))
    schema = StructType([queries.schema["query_id"], chunks.schema["chunk_id"], StructField("score", DoubleType())])
    types = asked.schema.field("query_id").type, chunks.limit(0).select("chunk_id").toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, of_size = shared.value
        places = defaultdict(list)
        for i, text in enumerate(texts):
            places[text].append(i)
        best = _Best(len(names), limit)
        for batch in batches:
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            own = np.array([(row, q) for row, text in enumerate(batch.column("name").to_pylist()) for q in places.get(text, ())], np.int64).reshape(-1, 2)
            for size, (rows, held) in _units(batch.column("vector")).items():
                where, wanted = of_size.get(size, (np.empty(0, np.int64), None))
                for a in range(0, len(rows), TILE):
                    for b in range(0, len(where), TILE):
                        q, c, score = _tile(wanted, held, a, b, best.bound[where[b : b + TILE]], limit, own, rows, where)
                        best.add(where[q], ids[rows[c]], score)
                    if best.waiting > len(names) * limit:
                        best.settle()
        q, found, score = best.settle()
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(names[q[part]], types[0]), pa.array(found[part], types[1]), pa.array(score[part])], ["query_id", "chunk_id", "score"])

    return chunks.select("chunk_id", F.col("chunk_id").cast("string").alias("name"), "vector").mapInArrow(run, schema)
