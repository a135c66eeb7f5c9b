"""Packing by concatenation: two passes of prefix sums give every id its place in one long sequence.

Pass one encodes each document once and keeps, with its ids, the place it has
within its partition.  The partitions' totals, summed up in order, give every
partition its offset.  Pass two is local to a row: the row's own offset says
which fixed windows it falls into, and where it has to be cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .tokens import PieceCache, default_path, texts, tokenizer

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """part, place, doc_id, n, ids: the ids as little-endian numbers of 2 or 4 bytes, and their place in the partition."""
    kind = np.dtype("<u2") if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else np.dtype("<u4")
    last = kind.type(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        cache = PieceCache(path, lambda ids: np.array(ids, kind).tobytes())
        for batch in batches:
            places, sizes, ids, waiting, begun = [], [], [], 0, 0
            for i, text in enumerate(texts(batch.column(1))):
                pieces = cache.split(text)
                table = cache.table(pieces)
                out = b"".join([table[p] for p in pieces]) + last
                places.append(place)
                sizes.append(len(out) // kind.itemsize)
                ids.append(out)
                place += sizes[-1]
                waiting += len(out)
                if waiting > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(ids), pa.int64()), pa.array(places, pa.int64()), batch.column(0).slice(begun, len(ids)), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                        ["part", "place", "doc_id", "n", "ids"],
                    )
                    places, sizes, ids, waiting, begun = [], [], [], 0, i + 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "part long, place long, doc_id long, n long, ids binary")


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 1) -> DataFrame:
    """One row for each piece: the ids [start, start + length) of a document lie at ``offset`` of sequence ``sequence_id``.

    Every sequence but the last is full.  A null or empty text is its end id alone.  Rows are packed as they are:
    repeated rows are packed repeatedly.  An empty table gives no pieces.
    """
    path = path or default_path()
    wide = 2 if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
    kept = scratch.write(spark, encoded(docs, path, end), "encoded")
    totals = sorted((r.part, r.total) for r in kept.groupBy("part").agg(F.sum("n").alias("total")).collect())  # a row for each partition
    offsets, at = {}, 0
    for part, total in totals:
        offsets[part], at = at, at + total
    shared = spark.sparkContext.broadcast(offsets)
    kind = np.dtype(f"<u{wide}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            columns = (batch.column(i).to_pylist() for i in range(4))
            for part, place, doc, n, ids in zip(*columns, batch.column(4), strict=True):
                wide_ids = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                where, start = base[part] + place, 0
                while start < n:
                    sequence, offset = divmod(where + start, size)
                    length = min(size - offset, n - start)
                    for column, value in zip(out, (doc, start, length, zlib.crc32(wide_ids[start : start + length].tobytes()), n, sequence, offset), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in _PIECES.split(", ")])

    return kept.mapInArrow(cut, _PIECES)
