"""Exact token counts and ids of a public tokenizer, without shuffling a word.

White space always ends a pre-token of this vocabulary, so a text's ids are the
ids of its white-space separated pieces one after the other.  Counting uses two
tiers: a compact table of the corpus's frequent pieces, broadcast, and a
bounded cache in each worker through which the rest is encoded by the
tokenizer library itself.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import kernel, scratch

#: A piece is frequent with this share of all pieces, so the table has 1 / SHARE rows at most.
SHARE = 1e-5
#: Entries of each of a worker's two cache generations; a full one becomes the old one, from which used entries return.
CACHE = 250_000
#: Longer pieces (unbroken scripts, blobs) are encoded but not kept.
LONGEST = 48

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Western letters, then ASCII punctuation: two pre-tokens of which the first needs no normalisation but lower case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class PieceCache:
    """piece -> value, bounded.  ``value`` turns a run of ids into something that ``+`` joins: their number, their bytes."""

    def __init__(self, path: str, value: Callable[[list[int]], object], frequent: dict[bytes, object] | None = None):
        known = tokenizer(path)
        self.encode, self.model = known.encode_batch_fast, known.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(65, 256)) if _PLAIN.fullmatch(c + "!")]
        self.spelled = str.maketrans({c: bytewise.pre_tokenize_str(c.lower())[0][0] for c in letters})
        self.value, self.frequent, self.rest, self.old, self.tails = value, frequent or {}, {}, {}, {}

    def split(self, text: bytes) -> list[bytes]:
        """Pieces of a text.  The vocabulary has lower case only; special strings are told by case, so it stays with them."""
        return (text if b"<|" in text else text.lower()).split()

    def _letters(self, word: str) -> object:
        """Ids of one pre-token of letters, by the library's model alone."""
        return self.value([t.id for t in self.model.tokenize(word.translate(self.spelled))])

    def _tail(self, tail: str) -> object:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.value(self.encode([tail], add_special_tokens=False)[0].ids)
        return self.tails[tail]

    def _resolve(self, missing: set[bytes]) -> dict[bytes, object]:
        found: dict[bytes, object] = {}
        known, others = ChainMap(found, self.rest, self.old, self.frequent).get, []
        for p in missing:
            if m := _PLAIN.fullmatch(word := p.decode("utf-8", "replace")):
                if m[2]:
                    bare = m[1].encode()
                    if (head := known(bare)) is None:
                        found[bare] = head = self._letters(m[1])
                    found[p] = head + self._tail(m[2])
                else:
                    found[p] = self._letters(word)
            else:
                others.append((p, word))
        if others:
            found |= {p: self.value(e.ids) for (p, _), e in zip(others, self.encode([w for _, w in others], add_special_tokens=False), strict=True)}
        return found

    def table(self, pieces: list[bytes]) -> Mapping[bytes, object]:
        """A mapping that holds every piece outside the frequent ones."""
        rest, frequent = self.rest, self.frequent
        missing = {p for p in pieces if p not in frequent and p not in rest}
        if not missing:
            return rest
        if len(rest) + len(missing) > CACHE:
            self.old, self.rest = rest, (rest := {})
            missing = {p for p in pieces if p not in frequent}
        old = self.old
        if back := {p: old[p] for p in missing if p in old}:
            rest.update(back)
            missing -= back.keys()
        found = self._resolve(missing)
        if all(len(p) <= LONGEST for p in found):
            rest.update(found)
            return rest
        rest.update((p, v) for p, v in found.items() if len(p) <= LONGEST)
        return ChainMap(found, rest)


def texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = kernel.buffers(column)
    raw = memoryview(data)
    for i in range(len(offsets) - 1):
        yield bytes(raw[offsets[i] : offsets[i + 1]])


def frequent_pieces(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """piece, n of every piece that makes up ``share`` of all: lossy counting in each partition, then one small sum.

    A partition forgets only pieces too rare in it.  The summaries, 1 / share rows of a partition at most, are what is
    shuffled; the pieces of the documents never are.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total, cut = 0, 0
        for batch in batches:
            for text in texts(batch.column(0)):
                pieces = (text if b"<|" in text else text.lower()).split()
                total += len(pieces)
                seen.update(pieces)
                if len(seen) > 300_000:
                    cut += 1
                    while len(seen) > 150_000:
                        seen = Counter({p: n for p, n in seen.items() if n > cut})
                        cut += len(seen) > 150_000
        kept = [(p, n) for p, n in seen.items() if n + cut >= share * total and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([b""] + [p for p, _ in kept], pa.binary()), pa.array([total] + [n for _, n in kept], pa.int64())], ["piece", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(summary, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = 2048, share: float = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents(doc_id, text).

    A null or empty text has no bytes and no tokens; repeated rows give repeated results; other columns are ignored.
    Special strings inside a text are handled as the library does by default.
    """
    path = path or default_path()
    summary = scratch.write(spark, frequent_pieces(docs, share), "pieces")
    total = summary.filter(F.length("piece") == 0).agg(F.sum("n")).first()[0] or 0
    ranked = [bytes(r.piece) for r in summary.filter((F.length("piece") > 0) & (F.col("n") >= share * total)).collect()]
    scratch.drop(spark, summary)
    lengths = [len(e) for e in tokenizer(path).encode_batch([p.decode("utf-8", "replace") for p in ranked], add_special_tokens=False)]
    shared = spark.sparkContext.broadcast(dict(zip(ranked, lengths, strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        cache = PieceCache(path, len, frequent)
        for batch in batches:
            sizes, counts = [], []
            for text in texts(batch.column(1)):
                pieces = cache.split(text)
                rest = cache.table(pieces)
                counts.append(sum([frequent[p] if p in frequent else rest[p] for p in pieces]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
