"""Toxicity scores from the nearest labelled examples.

Examples are a bounded sample of labelled documents, vectors over all their
words; near copies with one label are one example.  A word weighs TF-IDF, with
document frequencies of all documents, times how far its presence depends on
the label in that sample (near copies counted once).  A document's nearest
examples by exact cosine are found in a block-max inverted index: short posting
lists are added up whole, and of the long ones only those blocks of examples
whose largest weights can still lift one to the k-th cosine.  Distance-weighted
votes, calibrated on the examples themselves with each left out of its own
vote, are the scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, scratch

#: Labelled documents to learn from, at most, one text of each: those with the smallest hash of their id.
EXAMPLES = 20_000
#: Distinct words of all examples together, at most (12 bytes each in a worker): later examples by that hash are left out.
POSTINGS = 16_000_000
#: Neighbours that vote, and examples of a block of the index.
NEIGHBOURS, RANGE = 15, 64
#: The share of examples from which on a list is a plain row of its blocks.
PLAIN = 0.05
#: Documents searched together, and blocks that each is compared with first.
TOGETHER, FIRST = 64, 6
#: Documents with this remainder of crc32(doc_id as text) are held out.
FOLDS, HELD_OUT = 5, 0


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents with the fingerprints of their words and each document's first word."""
    data, offsets = kernel.buffers(column)
    for i, j in kernel.slices(offsets, 1 << 20):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = kernel.spans(part, offsets[i : j + 1] - offsets[i], kernel.ALNUM)
        yield i, j, kernel.word_hashes(part, starts, ends, True), first


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, words, counts, sketch (its two smallest 5-word shingles) of the sampled training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found, first in _words(batch.column(2)):
                whole = kernel.shingle_sets(found, first, 5)
                bags = [np.unique(found[first[d] : first[d + 1]], return_counts=True) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x.view(np.int64) for x, _ in bags], pa.list_(pa.int64())),
                        pa.array([n for _, n in bags], pa.list_(pa.int64())),
                        pa.array([int(kernel.window_hashes(x[:2], 2).view(np.int64)[0]) if len(x) else 0 for x in whole], pa.int64()),
                    ],
                    ["doc_id", "toxic", "words", "counts", "sketch"],
                )

    return texts.mapInArrow(run, "doc_id long, toxic int, words array<long>, counts array<long>, sketch long")


def _within(spark: SparkSession, examples: DataFrame) -> DataFrame:
    """The examples whose distinct words come to POSTINGS at most, by hash of their id; EXAMPLES sizes pass the driver."""
    sizes = sorted(examples.select(F.xxhash64("doc_id").alias("hash"), "doc_id", F.size("words").alias("n")).collect())
    total, kept = 0, 0
    while kept < len(sizes) and total + sizes[kept].n <= POSTINGS:
        total, kept = total + sizes[kept].n, kept + 1
    if kept == len(sizes):
        return examples
    name, past = F.xxhash64("doc_id"), sizes[kept]
    return examples.filter((name < past.hash) | ((name == past.hash) & (F.col("doc_id") < past.doc_id)))


def _vocabulary(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of all words of the examples, and 1 + G2 of each: what chance gives, and what the label adds."""
    once = examples.groupBy("sketch").agg(F.max("toxic").alias("toxic"))
    n1, n0 = ((r.a or 0), (r.b or 0)) if (r := once.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()) else (0, 0)
    if not n1 or not n0:
        return np.empty(0, np.uint64), np.empty(0)
    seen = examples.select("sketch", "toxic", F.explode("words").alias("word")).groupBy("word", "sketch").agg(F.max("toxic").alias("toxic"))
    table = seen.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    total = n1 + n0
    cell = lambda x, row, column: F.when(x > 0, x * F.log(x * total / (row * column))).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    c, d = n1 - a, n0 - b
    g2 = 2 * (cell(a, a + b, F.lit(n1)) + cell(b, a + b, F.lit(n0)) + cell(c, c + d, F.lit(n1)) + cell(d, c + d, F.lit(n0)))
    rows = table.select("word", g2.alias("g2")).toArrow()
    words = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], 1 + np.maximum(rows.column("g2").to_numpy()[order], 0)


def _bags(found: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the vocabulary's words, by document, then term."""
    if not len(vocabulary) or not len(found):
        return (np.empty(0, np.int64),) * 3
    place = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[place] == found)
    doc = np.searchsorted(first, at, side="right") - 1
    pairs, counts = np.unique(doc * len(vocabulary) + place[at], return_counts=True)
    return pairs // len(vocabulary), pairs % len(vocabulary), counts


def _frequencies(docs: DataFrame, shared: Broadcast, terms: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, of all documents, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, found, first in _words(batch.column(0)):
                total += np.bincount(_bags(found, first, shared.value)[1], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], rows), pa.int64())], ["term", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    out = np.zeros(terms)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of one document's terms."""
    raw = (1 + np.log(counts)) * idf
    return raw / np.sqrt((raw * raw).sum())


def _slices(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all slices one after another, and the number of each one's slice."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (starts - np.cumsum(sizes) + sizes)[of], of


class BlockMaxIndex:
    """Posting lists over examples in blocks of RANGE, with the largest weight of each list in each block.

    Examples stand in the order of their heaviest words, so that a block holds like ones.  Lists of more than PLAIN
    of all examples are rows of their blocks; they are added up, for many documents at once, in those blocks only
    whose largest weights can lift an example to a document's k-th cosine.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        first = np.cumsum([0, *[len(x) for x, _ in vectors]], dtype=np.int64)
        where = np.concatenate([np.empty(0, np.int32), *[x.astype(np.int32) for x, _ in vectors]])
        self._build(first, where, np.concatenate([np.empty(0, np.float32), *[w.astype(np.float32) for _, w in vectors]]), terms)

    @classmethod
    def of(cls, first: np.ndarray, where: np.ndarray, weight: np.ndarray, terms: int) -> BlockMaxIndex:
        """The index of examples e with terms where[first[e]:first[e + 1]]; each has one term at least."""
        index = cls.__new__(cls)
        index._build(first, where, weight, terms)
        return index

    def _build(self, first: np.ndarray, where: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.size, self.first, self.where, self.weight = len(first) - 1, first, where, weight
        self.blocks = -(-self.size // RANGE)
        self.asked = np.zeros(terms)
        owner = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(first))
        heaviest = np.maximum.reduceat(weight, first[:-1]) if self.size else weight
        at = np.flatnonzero(weight == heaviest[owner]) if self.size else np.empty(0, np.int64)
        top = where[at[np.unique(owner[at], return_index=True)[1]]]
        self.number = np.lexsort((-heaviest, top))  # the example at each place
        place = np.empty(self.size, np.int32)
        place[self.number] = np.arange(self.size, dtype=np.int32)
        owner = place[owner]
        held = np.bincount(where, minlength=terms)
        plain = np.flatnonzero(held > PLAIN * self.size)
        self.row = np.full(terms, -1, np.int32)
        self.row[plain] = np.arange(len(plain))
        self.plain = np.zeros((self.blocks, len(plain), RANGE), np.float32)
        row = self.row[where]
        own = np.flatnonzero(row >= 0)
        self.plain[owner[own] // RANGE, row[own], owner[own] % RANGE] = weight[own]
        self.most = np.ascontiguousarray(self.plain.max(2).T) if self.blocks else np.zeros((len(plain), 0), np.float32)
        own = np.flatnonzero(row < 0)
        own = own[np.argsort(where[own], kind="stable")]
        self.example, self.impact = owner[own], weight[own]
        self.list = np.concatenate([[0], np.cumsum(np.where(self.row < 0, held, 0))])

    def _exact(self, some: np.ndarray, where: np.ndarray, weight: np.ndarray) -> np.ndarray:
        self.asked[where] = weight
        at, of = _slices(self.first[some], self.first[some + 1])
        out = np.bincount(of, self.asked[self.where[at]] * self.weight[at], len(some))
        self.asked[where] = 0
        return out

    def nearest(self, where: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, ties to the smaller number."""
        return self.nearest_of([(where, weight)], k)[0]

    def nearest_of(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of several documents."""
        n, m = len(asked), self.blocks
        if not n or not m:
            return [(np.empty(0, np.int64), np.empty(0))] * n
        dense = np.zeros((n, self.plain.shape[1]), np.float32)
        sums = np.zeros((n, m * RANGE), np.float32)
        for d, (where, weight) in enumerate(asked):
            row = self.row[where]
            dense[d, row[row >= 0]] = weight[row >= 0]
            short = where[row < 0]
            at, of = _slices(self.list[short], self.list[short + 1])
            if len(at):
                sums[d] = np.bincount(self.example[at], weight[row < 0].astype(np.float32)[of] * self.impact[at], m * RANGE)
        sums = sums.reshape(n, m, RANGE)
        bound = sums.max(2) + dense @ self.most
        best = np.argpartition(-bound, min(FIRST, m) - 1, axis=1)[:, :FIRST]
        todo = np.zeros((n, m), bool)
        np.put_along_axis(todo, best, True, 1)
        self._add(sums, dense, todo)
        slack = 1e-4  # the sums have single precision and only choose whom to compare
        seen = np.take_along_axis(sums, best[:, :, None], 1).reshape(n, -1)
        least = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k] - slack if seen.shape[1] >= k else np.zeros(n)
        more = (bound >= least[:, None]) & (bound > 0) & ~todo
        self._add(sums, dense, more)
        todo |= more
        sums[~todo] = 0
        out = []
        for (where, weight), mine, enough in zip(asked, sums.reshape(n, -1), least, strict=True):
            some = np.flatnonzero(mine >= enough) if enough > 0 else np.flatnonzero(mine > 0)
            if len(some) > k:
                value = mine[some]
                some = some[value >= np.partition(value, len(some) - k)[-k] - slack]
            some = np.sort(self.number[some])
            found = self._exact(some, where, weight)
            order = np.lexsort((some, -found))[:k]
            order = order[found[order] > 0]
            out.append((some[order], found[order]))
        return out

    def _add(self, sums: np.ndarray, dense: np.ndarray, todo: np.ndarray) -> None:
        """Adds the plain rows of each block to the sums of the documents it is to be compared with."""
        for b in np.flatnonzero(todo.any(0)).tolist():
            docs = np.flatnonzero(todo[:, b])
            sums[docs, b] += dense[docs] @ self.plain[b]


def _vote(cosine: np.ndarray, toxic: np.ndarray) -> float:
    weight = 1 / (1.05 - np.minimum(cosine, 1.0))
    return float((weight * toxic).sum() / weight.sum())


def _isotonic(votes: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: vote thresholds and the share of toxic examples from each on."""
    levels, place = np.unique(votes, return_inverse=True)
    stack: list[list[float]] = []  # least vote, toxic, all
    for v, a, n in zip(levels, np.bincount(place, truth), np.bincount(place), strict=True):
        stack.append([v, a, n])
        while len(stack) > 1 and stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]:
            _, a2, n2 = stack.pop()
            stack[-1][1] += a2
            stack[-1][2] += n2
    return np.array([s[0] for s in stack]), np.array([(s[1] + 0.05) / (s[2] + 0.1) for s in stack])


def _vectors(examples: DataFrame, shared: Broadcast) -> pa.Table:
    """doc_id, toxic, sketch, terms, counts (as bytes of int32) of each example: little is left of it for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for k in range(batch.num_rows):
                found = batch.column(3)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = len(shared.value) > 0  # else no word tells labels apart
                terms.append((np.searchsorted(shared.value, found) if own else found[:0]).astype(np.int32).tobytes())
                counts.append(batch.column(4)[k].values.to_numpy(zero_copy_only=False)[: None if own else 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "toxic", "sketch", "terms", "counts"],
            )

    schema = "doc_id long, toxic int, sketch long, terms binary, counts binary"
    return examples.select("doc_id", "toxic", "sketch", "words", "counts").mapInArrow(run, schema).toArrow()


def _planes(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplaned(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


class Model:
    """Weights, examples and, once calibrated, the steps of the scores: bounded by EXAMPLES and POSTINGS.

    Examples travel as terms and counts, packed; each worker makes its index of them once.
    """

    def __init__(self, telling: np.ndarray, frequency: np.ndarray, documents: int, rows: pa.Table):
        self.idf = (np.log((1 + documents) / (1 + frequency)) + 1) * telling
        rows = rows.sort_by([("doc_id", "ascending"), ("sketch", "ascending")])
        toxic, sketch = rows.column("toxic").to_numpy(), rows.column("sketch").to_numpy()
        sizes = np.diff(kernel.buffers(rows.column("terms"))[1]) // 4
        self.silent = (toxic[sizes == 0].sum() + 0.05) / ((sizes == 0).sum() + 1)
        once = np.sort(np.unique(np.stack([sketch, toxic.astype(np.int64)], 1), axis=0, return_index=True)[1])
        rows = rows.take(once[sizes[once] > 0])
        self.toxic, self.ids = rows.column("toxic").to_numpy().astype(np.float64), rows.column("doc_id").to_numpy().astype(np.int64)
        raw, offsets = kernel.buffers(rows.column("terms"))
        self.first = offsets // 4
        self.packed = _planes(np.diff(raw.view(np.uint32), prepend=np.zeros(1, np.uint32))), _planes(kernel.buffers(rows.column("counts"))[0].view(np.uint32))
        self.made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    @property
    def index(self) -> BlockMaxIndex:
        if self.made is None:
            where = np.cumsum(_unplaned(self.packed[0]), dtype=np.uint32).astype(np.int32)
            raw = (1 + np.log(_unplaned(self.packed[1]).astype(np.float32))) * self.idf.astype(np.float32)[where]
            if len(self.ids):
                raw /= np.repeat(np.sqrt(np.add.reduceat(raw * raw, self.first[:-1])), np.diff(self.first))
            self.made = BlockMaxIndex.of(self.first, where, raw, len(self.idf))
        return self.made

    def votes(self, examples: list[int]) -> list[float]:
        """The votes of the other examples on some of them."""
        index, out = self.index, []
        cut = [(index.first[e], index.first[e + 1]) for e in examples]
        asked = [(index.where[a:b], index.weight[a:b].astype(np.float64)) for a, b in cut]
        for e, (near, cosine) in zip(examples, index.nearest_of(asked, NEIGHBOURS + 1), strict=True):
            others = near != e
            out.append(_vote(cosine[others][:NEIGHBOURS], self.toxic[near[others][:NEIGHBOURS]]) if others.any() else self.silent)
        return out

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]], steps: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[dict]]]:
        """Scores and first neighbours of documents given as terms and counts."""
        asked = [(terms, weights(counts, self.idf[terms])) if len(terms) else (terms, np.empty(0)) for terms, counts in bags]
        out = []
        for near, cosine in self.index.nearest_of(asked, NEIGHBOURS):
            if not len(near):
                out.append((self.silent, []))
                continue
            step = max(0, int(np.searchsorted(steps[0], _vote(cosine, self.toxic[near]), side="right")) - 1)
            out.append((float(steps[1][step]), [{"doc_id": int(self.ids[e]), "cosine": float(c), "toxic": int(self.toxic[e])} for e, c in zip(near[:3], cosine[:3], strict=True)]))
        return out


def _calibrated(spark: SparkSession, model: Broadcast, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the scores from the examples' votes on each other, worked out by the executors."""
    if not len(toxic):
        return np.empty(0), np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.column(0).slice(i, TOGETHER)
                yield pa.RecordBatch.from_arrays([part, pa.array(model.value.votes(part.to_pylist()), pa.float64())], ["e", "vote"])

    tasks = max(1, min(len(toxic) // 200, 4 * spark.sparkContext.defaultParallelism))
    votes = spark.range(0, len(toxic), 1, tasks).mapInArrow(run, "e long, vote double").toArrow()
    return _isotonic(votes.column("vote").to_numpy(), toxic[votes.column("e").to_numpy()])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, nearest of every row of documents(doc_id, text).

    Nearest are the first three examples by cosine; they are the evidence of a row that is predicted toxic.
    Learns from labels(doc_id, toxic) of rows outside the held-out fold; several labels of a document count as
    the largest, and of several texts of a doc_id one is an example.  Null, empty and texts that share no word with an
    example get the share of toxic examples among those without words.  Without labels of both kinds that share is the score of all.  Repeated rows are repeated.
    """
    held = scratch.write(spark, _examples(docs, labels), "examples")
    examples = _within(spark, held)
    vocabulary, telling = _vocabulary(examples)
    shared = spark.sparkContext.broadcast(vocabulary)
    frequency, documents = _frequencies(docs, shared, len(vocabulary))
    made = Model(telling, frequency, documents, _vectors(examples, shared))
    model = spark.sparkContext.broadcast(made)
    scratch.drop(spark, held)
    steps = _calibrated(spark, model, made.toxic)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def scored(bags: list[tuple[np.ndarray, np.ndarray]], known: dict) -> list[tuple[float, list[dict]]]:
        """Scores of documents, equal bags of words once."""
        keys = [hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() for t, n in bags]
        if len(known) > 50_000:
            known.clear()
        fresh = {key: bag for key, bag in zip(keys, bags, strict=True) if key not in known}
        for i in range(0, len(fresh), TOGETHER):
            some = list(fresh)[i : i + TOGETHER]
            known.update(zip(some, model.value.scores([fresh[key] for key in some], steps), strict=True))
        return [known[key] for key in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i, j, found, first in _words(batch.column(2)):
                doc, term, count = _bags(found, first, shared.value)
                cut = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                both = scored([(term[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], known)
                scores, nearest = [s for s, _ in both], [e for _, e in both]
                part = batch.slice(i, j - i)
                evidence = [e if s >= 0.5 else [] for s, e in both]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                        pa.array(evidence, kind), pa.array(nearest, kind),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "evidence", "nearest"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    near = "array<struct<doc_id:long,cosine:double,toxic:int>>"
    return rows.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, evidence {near}, nearest {near}")
