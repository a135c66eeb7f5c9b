"""Removal of spans that occur in given reference texts, by suffix automata of reference shards.

The reference is cut into shards of bounded size.  Each shard's automaton
accepts every run of words that occurs in it; it is built once, broadcast, and
all documents stream through it for their matching statistics: at each word,
how long a run that ends there occurs in the shard.  Runs of ``size`` words
and more mark their words, and the marks of all shards are united.

Work is documents times shards, so this serves a reference of a stated size.
For repeats within the corpus itself see substring_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .tokens import texts

#: Words of a shard: its automaton takes some 1 kB for each in a worker.
SHARD = 50_000


class SuffixAutomaton:
    """All runs of words that lie within one of the texts."""

    def __init__(self, parts: list[list[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in parts:
            last = 0
            for word in words:
                last = self._add(last, word)

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, before: int, word: bytes, target: int) -> int:
        """The state of the run before + word, split off a state that also stands for longer ones."""
        if self.length[target] == self.length[before] + 1:
            return target
        copy = self._state(self.length[before] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while before >= 0 and self.step[before].get(word) == target:
            self.step[before][word] = copy
            before = self.link[before]
        return copy

    def _add(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.step[last][word])
        return new

    def lengths(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: the longest run that ends at each word."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.step[state]:
                state, size = self.step[state][word], size + 1
            else:
                size = 0
            yield size


def remove_reference_spans(spark: SparkSession, docs: DataFrame, reference: DataFrame, size: int = 35, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, text of every row of documents(doc_id, text), without spans that reference(text) holds.

    Null and empty texts have no words.  Reference texts are cut at a shard's end with ``size`` - 1 words of overlap,
    so no run of ``size`` words is lost between shards.
    """
    pieces = reference.select(F.split(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+").alias("w"))
    cut = pieces.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(shard)), lambda i: F.slice("w", i, F.lit(shard + size - 1)))).alias("w")).filter(F.size("w") >= size)
    numbered = cut.withColumn("hash", F.sha2(F.to_binary(F.array_join("w", " "), F.lit("utf-8")), 256)).dropDuplicates(["hash"]).withColumn("part", F.spark_partition_id())
    numbered = scratch.write(spark, numbered, "reference")
    place = F.floor(F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("part").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / shard)
    shards = scratch.write(spark, numbered.withColumn("place", place), "shards")
    marks = None
    for row in shards.select("part", "place").distinct().sort("part", "place").toLocalIterator():
        held = shards.filter((F.col("part") == row.part) & (F.col("place") == row.place)).select("w").collect()  # two shards' words at most
        shared = spark.sparkContext.broadcast(SuffixAutomaton([[x.encode() for x in r.w] for r in held]))
        found = scratch.write(spark, _marked(docs, shared, size), "marks")
        shared.unpersist()
        marks = found if marks is None else marks.unionByName(found)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sum", F.xxhash64("text"))
    if marks is not None:
        spans = marks.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sum") == F.col("_sum")), "left")
    else:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<start:long,end:long>>"))
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")


def _marked(docs: DataFrame, shared, size: int) -> DataFrame:
    """doc_id, sum, start, end of the maximal runs of words that one shard marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for doc, sum_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                start = end = -1
                for at, n in enumerate(shared.value.lengths(text.split()), 1):
                    if n >= size:
                        if at - n > end:
                            if end > 0:
                                [c.append(v) for c, v in zip(out, (doc, sum_, start, end), strict=True)]
                            start = at - n
                        start, end = min(start, at - n), at
                if end > 0:
                    [c.append(v) for c, v in zip(out, (doc, sum_, start, end), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "sum", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("sum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sum long, start long, end long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), bool)
            for s in spans or []:
                gone[s["start"] : s["end"]] = True
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


#: Words of a span that documents may not share with the benchmark.
SPAN = 13
_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT DISTINCT array_to_string(w[i:i + {SPAN - 1}], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM (SELECT {_W} AS w FROM benchmark) WHERE len(w) >= {SPAN})),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {SPAN - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d WHERE len(w) >= {SPAN})),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS pos FROM g SEMI JOIN b USING (g)),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN x USING (doc_id, pos) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
