"""Blocks of documents, and counts of fingerprints over all blocks.

Counting every word window of a corpus by a shuffle of one row per window costs
more than the corpus.  Instead documents are bundled into blocks of bounded
size, and each block sends, for every range of the fingerprint space, its
sorted distinct fingerprints as one delta-coded binary.  A range adds the
blocks up and answers each with the global counts in the same order.  However
frequent a fingerprint is, a block names it once, so no range is hot, and what
comes back to a block is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, scratch

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 8_000_000
#: Fingerprints that a range receives, at about this many from all blocks together.
RANGE = 2_000_000

_SCHEMA = "block long, ids array<long>, sizes array<int>, text binary"


def _bundle(ids: list, sizes: list, parts: list, block: int) -> pa.RecordBatch:
    text = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([text], pa.binary())],
        ["block", "ids", "sizes", "text"],
    )


def blocks(spark: SparkSession, docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Documents as blocks, written to the shared folder: a block keeps its number and rows from now on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        ids, sizes, parts = [], [], []
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in kernel.slices(offsets, limit):
                size = int(offsets[j] - offsets[i])
                if held and held + size > limit:
                    yield _bundle(ids, sizes, parts, block)
                    block, held, ids, sizes, parts = block + 1, 0, [], [], []
                ids += keys[i:j]
                sizes += np.diff(offsets[i : j + 1]).tolist()
                parts.append(data[offsets[i] : offsets[j]].tobytes())
                held += size
        if ids:
            yield _bundle(ids, sizes, parts, block)

    return scratch.write(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA), "blocks")


class Block:
    """One block in a task: document ids, byte buffer and offsets."""

    def __init__(self, number: int, ids: pa.ListScalar, sizes: pa.ListScalar, text: pa.BinaryScalar):
        self.number = number
        self.ids = ids.values
        self.offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text.as_buffer(), max_output_size=max(1, int(self.offsets[-1]))), np.uint8)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, bytes, offsets) of runs of documents, small enough for the arrays of the kernel."""
        for i, j in kernel.slices(self.offsets, 1 << 20):
            yield i, j, self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]


def each(table: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for k in range(table.num_rows):
        yield Block(table.column("block")[k].as_py(), table.column("ids")[k], table.column("sizes")[k], table.column("text")[k])


def words(block: Block, inside: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of a block, and each document's first word."""
    found, firsts, total = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in block:
        starts, ends, first = kernel.spans(data, offsets, inside)
        found.append(kernel.word_hashes(data, starts, ends, fold))
        firsts.append(first[1:] + total)
        total += len(starts)
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), np.concatenate(firsts)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as deltas in byte planes."""
    deltas = np.diff(values, prepend=np.zeros(1, values.dtype))
    return zstandard.ZstdCompressor(level=1).compress(deltas.view(np.uint8).reshape(-1, 8).T.tobytes())


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in byte planes: mostly ones, so next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted values pass from one range of the fingerprint space to the next."""
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]])


def ranges_for(total: int) -> int:
    return max(1, -(-total // RANGE))


def global_counts(made: DataFrame, fingerprints: Callable[[Block], tuple[np.ndarray, np.ndarray]], ranges: int, share: float | None = None) -> DataFrame:
    """block, range, counts: for each range, the global counts of the block's distinct fingerprints in ascending order.

    ``fingerprints`` gives a block's sorted distinct fingerprints and how often the block counts each.  One row of
    each range also has its number of counted fingerprints, their total, and, given a share, the fingerprints
    that make up at least that share of the range.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in each(batch):
                values, counts = fingerprints(block)
                at = cuts(values, ranges)
                full = [r for r in range(ranges) if at[r] < at[r + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([block.number] * len(full), pa.int64()),
                        pa.array([squeeze(values[at[r] : at[r + 1]]) for r in full], pa.binary()),
                        pa.array([pack_counts(counts[at[r] : at[r + 1]]) for r in full], pa.binary()),
                    ],
                    ["range", "block", "found", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        found = [expand(x.as_buffer()) for x in table.column("found")]
        values, place = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros(len(values), np.uint64)
        sizes = np.cumsum([0] + [len(x) for x in found])
        mine = [place[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        for at, counts in zip(mine, table.column("counts"), strict=True):
            total[at] += unpack_counts(counts.as_buffer())
        answers = [pack_counts(total[at]) for at in mine]
        others = len(answers) - 1
        top = np.flatnonzero(total >= max(1, share * float(total.sum()))) if share is not None else []
        tops = [[{"hash": h, "n": n} for h, n in zip(values[top].view(np.int64).tolist(), total[top].tolist(), strict=True)]]
        return pa.Table.from_arrays(
            [table.column("block"), table.column("range"), pa.array(answers, pa.binary()), pa.array([int((total > 0).sum())] + [0] * others, pa.int64()), pa.array([int(total.sum())] + [0] * others, pa.int64()), pa.array(tops + [[]] * others, pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())])))],
            ["block", "range", "counts", "distinct", "total", "top"],
        )

    sent = made.mapInArrow(send, "range int, block long, found binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "block long, range int, counts binary, distinct long, total long, top array<struct<hash:long,n:long>>")


def joined_counts(table: pa.Table) -> np.ndarray:
    """The answers of all ranges to one block, in the order of its sorted fingerprints."""
    if table.num_rows == 0:
        return np.empty(0, np.uint64)
    order = np.argsort(table.column("range").to_numpy(), kind="stable")
    answers = table.column("counts")
    return np.concatenate([unpack_counts(answers[int(i)].as_buffer()) for i in order])


def with_counts(made: DataFrame, counts: DataFrame, apply: Callable[[Block, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """apply(block, global counts) for every block."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        known = joined_counts(right)
        return pa.concat_tables([apply(block, known) for block in each(left)])

    return made.groupBy("block").cogroup(counts.select("block", "range", "counts").groupBy("block")).applyInArrow(both, schema)
