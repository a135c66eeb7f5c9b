"""Removal of passages that repeat anywhere in the corpus.

A word is removed when a window of ``size`` words that covers it occurs at
another place too.  Windows are counted over all documents by their
fingerprints (see blocks.global_counts); the answers come back to the block in
which the window lies, which then cuts its repeated windows' union out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, kernel


def _windows(block: blocks.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all whole windows, the words at which they start, and each document's first word."""
    found, first = blocks.words(block, kernel.NO_SPACE, False)
    starts = np.flatnonzero(kernel.window_starts(first, size))
    return kernel.window_hashes(found, size)[starts], starts, first


def remove_repeats(spark: SparkSession, docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by a space) for every row of documents(doc_id, text).

    Words are separated by ASCII white space and compared unchanged.  All windows are judged on the input, a
    document's own repeats included, so every copy of a passage goes.  Null and empty texts have no words; rows
    are documents, so a repeated row of at least ``size`` words loses them all.
    """
    made = blocks.blocks(spark, docs)
    total = made.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0

    def distinct(block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_windows(block, size)[0], return_counts=True)

    def cut(block: blocks.Block, counts: np.ndarray) -> pa.Table:
        hashes, starts, first = _windows(block, size)
        values = np.unique(hashes)
        again = starts[counts[np.searchsorted(values, hashes)] > 1] if len(hashes) else starts
        cover = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + size, -1)
        gone = np.cumsum(cover)[:-1] > 0
        texts, removed = [], []
        raw = memoryview(block.data)
        for d in range(len(block.ids)):
            mine = gone[first[d] : first[d + 1]]
            found = bytes(raw[block.offsets[d] : block.offsets[d + 1]]).split()
            removed.append(int(mine.sum()))
            texts.append(b" ".join([w for w, g in zip(found, mine.tolist(), strict=True) if not g] if removed[-1] else found))
        return pa.Table.from_arrays(
            [block.ids, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "text"],
        )

    counts = blocks.global_counts(made, distinct, blocks.ranges_for(total // 6))
    return blocks.with_counts(made, counts, cut, "doc_id long, n_words long, n_removed long, text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
a AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM a),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN x USING (doc_id, pos) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
