"""The stored index of claims: texts in small units, and an inverted index in blocks with their largest weights.

Both lie sorted over ranges, so neither a source nor a phrase that a third of
the claims have is in one task: a unit holds at most ``UNIT`` claims of one
source in the order of their ids, a block at most ``POSTINGS`` of one phrase
from its largest weight down.  Full-text search reads only the blocks that can
still lift a claim among the best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import in_blocks, keep
from . import matching
from .asked import asked_terms, dealt, holding, ranked, searchable, tokens

#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Claims of a unit and postings of a block, at most; powers of two.
UNIT, POSTINGS = 64, 128
#: More than what rounding to six decimals and the order of sums change.
MARGIN = 2e-6


@dataclass
class Index:
    """Tables that are written once: see ``build_index``."""

    texts: DataFrame  # source_id, slot, claim_id, created_at, low (claim), text (claim and locator), both in lower case
    units: DataFrame  # source_id, slot, least
    postings: DataFrame  # phrase, slot, claim_id, weight
    blocks: DataFrame  # phrase, slot, most, n
    phrases: DataFrame  # phrase, df
    words: DataFrame  # claim_id, dl, words: map of phrase to weight
    claims: int
    length: float
    unit: float  # claims of a unit on average

    def frames(self) -> list[DataFrame]:
        return [self.texts, self.units, self.postings, self.blocks, self.phrases, self.words]


def weight(tf: Column, dl: Column, length: float) -> Column:
    """What a phrase adds to a claim's score, before its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / length))


def _slots(rows: DataFrame, keys: list, size: int) -> DataFrame:
    """Rows sorted over ranges, each with the number of its run of ``size`` rows."""
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return spread.withColumn("slot", F.shiftrightunsigned(F.monotonically_increasing_id(), size.bit_length() - 1))


def build_index(claims: DataFrame) -> Index:
    """The index of claims(claim_id, source_id, claim_text, citation_locator, created_at); phrases are single tokens."""
    low = F.lower(F.coalesce("claim_text", F.lit("")))
    texts = claims.select("source_id", "claim_id", "created_at", low.alias("low"), F.lower(F.concat_ws(" ", "claim_text", "citation_locator")).alias("text"))
    texts = keep(_slots(texts, ["source_id", "claim_id"], UNIT), "index-texts")
    units = keep(texts.groupBy("source_id", "slot").agg(F.min("claim_id").alias("least")), "index-units")
    rows = dealt(claims.select("claim_id", tokens(F.col("claim_text")).alias("tokens")), "claim_id")
    count, length = rows.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    length = float(length or 0) or 1.0
    found = rows.select("claim_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("phrase")).groupBy("claim_id", "dl", "phrase").agg(F.count("*").alias("tf"))
    found = found.select("claim_id", "dl", "phrase", weight(F.col("tf"), F.col("dl"), length).alias("weight"))
    words = keep(found.groupBy("claim_id").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("phrase", "weight"))).alias("words")), "index-words")
    flat = words.select("claim_id", F.explode("words").alias("phrase", "weight"))
    postings = keep(_slots(flat, ["phrase", F.desc("weight"), "claim_id"], POSTINGS), "index-postings")
    blocks = keep(postings.groupBy("phrase", "slot").agg(F.max("weight").alias("most"), F.count("*").alias("n")), "index-blocks")
    phrases = keep(blocks.groupBy("phrase").agg(F.sum("n").alias("df")), "index-phrases")
    return Index(texts, units, postings, blocks, phrases, words, count, length, count / max(1, units.count()))


def _long_phrases(asked: DataFrame, claims: DataFrame, index: Index) -> DataFrame | None:
    """claim_id, phrase, weight of the phrases of several tokens, which are found in the texts; None if none is asked for."""
    long = asked.select("phrase").distinct().filter(F.contains("phrase", F.lit(" ")))
    if long.isEmpty():
        return None
    words = tokens(F.col("claim_text"))
    line = claims.select("claim_id", F.size(words).alias("dl"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("line"))
    held = holding(line.withColumn("text", F.col("line")), long.select(F.concat(F.lit(" "), "phrase", F.lit(" ")).alias("term"), "phrase"), "claim_id")
    times = F.regexp_count("line", F.concat(F.lit("(?="), "term", F.lit(")"))).cast("long")
    return keep(held.select("claim_id", "phrase", weight(times, F.col("dl"), index.length).alias("weight")), "phrases")


def _exact(pairs: DataFrame, asked: DataFrame, index: Index, long: DataFrame | None) -> DataFrame:
    """The scores of pairs (query_id, claim_id), from the claims' own words."""
    single = asked.filter(~F.contains("phrase", F.lit(" "))).groupBy("query_id").agg(F.collect_list(F.struct("phrase", "factor")).alias("asked"))
    rows = pairs.join(index.words.select("claim_id", "words"), "claim_id").join(F.broadcast(single), "query_id", "left")
    add = lambda s, t: s + t["factor"] * F.coalesce(F.try_element_at("words", t["phrase"]), F.lit(0.0))
    rows = rows.select("query_id", "claim_id", F.coalesce(F.aggregate("asked", F.lit(0.0), add), F.lit(0.0)).alias("score"))
    if long is not None:
        more = long.join(F.broadcast(asked), "phrase").select("query_id", "claim_id", (F.col("factor") * F.col("weight")).alias("more"))
        more = more.groupBy("query_id", "claim_id").agg(F.sum("more").alias("more"))
        rows = rows.join(more, ["query_id", "claim_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    return rows.withColumn("bm25", F.round("score", 6)).drop("score")


def asked_phrases(questions: DataFrame) -> DataFrame:
    """query_id, phrase, times: a term of letters, digits and "_" is the phrase of its tokens; each spelling of it counts."""
    safe = asked_terms(questions, F.filter(searchable(questions), lambda t: t.rlike(r"^[\p{L}\p{N}\p{M}_]+$")))
    asked = safe.select("query_id", F.array_join(tokens(F.col("term")), " ").alias("phrase"), "times").filter(F.col("phrase") != "")
    return asked.groupBy("query_id", "phrase").agg(F.sum("times").alias("times"))


def _plan(questions: DataFrame, claims: DataFrame, index: Index, limit: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """What is asked with its factors, blocks by question with what they can add, long phrases, and the first candidates' scores.

    The first candidates are those of each question's blocks of largest worth, up to twice the limit.
    """
    times = keep(asked_phrases(questions), "phrases")
    long = _long_phrases(times, claims, index)
    df = index.phrases if long is None else index.phrases.unionByName(long.groupBy("phrase").agg(F.count("*").alias("df")))
    factor = F.col("times") * F.greatest(F.lit(1e-6), F.log((index.claims - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = keep(df.join(F.broadcast(times), "phrase").select("query_id", "phrase", factor.alias("factor")), "phrases")
    blocks = index.blocks.select("phrase", "slot", "most", "n")
    if long is not None:
        blocks = blocks.unionByName(long.groupBy("phrase").agg(F.lit(-1).cast("long").alias("slot"), F.max("weight").alias("most"), F.count("*").alias("n")))
    blocks = keep(blocks.join(F.broadcast(asked), "phrase").select("query_id", "phrase", "slot", "n", (F.col("factor") * F.col("most")).alias("worth")), "blocks")
    best = Window.partitionBy("query_id").orderBy(F.desc("worth"), "phrase", "slot")
    first = blocks.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= 2 * limit)
    first = first.withColumn("before", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("before", F.lit(0)) < 2 * limit)
    seeds = _read(first.select("query_id", "phrase", "slot"), index, long).select("query_id", "claim_id").distinct()
    return asked, blocks, long, keep(_exact(seeds, asked, index, long), "hits")


def _read(blocks: DataFrame, index: Index, long: DataFrame | None) -> DataFrame:
    """The postings of blocks (query_id, phrase, slot)."""
    found = blocks.join(index.postings, ["phrase", "slot"])
    return found if long is None else found.unionByName(blocks.filter("slot < 0").join(long, "phrase").select(*found.columns))


def _needed(asked: DataFrame, blocks: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """blocks with ``read``: whether a claim that reaches the limit-th score of the seeds can have its worthiest phrase there.

    Phrases go from the worthiest down; a claim in a block has none of those before its phrase or is found there, so
    the block's worth and all that later phrases can add bound its score.
    """
    reached = ranked(seeds, "bm25", limit).filter(F.col("rank") == limit).select("query_id", F.col("bm25").alias("reached"))
    worth = blocks.groupBy("query_id", "phrase").agg(F.max("worth").alias("top"))
    later = Window.partitionBy("query_id").orderBy(F.desc("top"), "phrase").rowsBetween(1, Window.unboundedFollowing)
    worth = worth.withColumn("later", F.coalesce(F.sum("top").over(later), F.lit(0.0))).join(reached, "query_id", "left")
    rows = blocks.join(F.broadcast(worth), ["query_id", "phrase"])
    return rows.withColumn("read", F.coalesce(F.col("worth") + F.col("later") + MARGIN >= F.col("reached"), F.lit(True)))


def _candidates(needed: DataFrame, index: Index, long: DataFrame | None, asked: DataFrame) -> DataFrame:
    """Pairs of the blocks that are read, if what is known of them and what the rest can add reach the limit-th score."""
    unread = needed.groupBy("query_id", "phrase").agg(F.coalesce(F.max(F.when(~F.col("read"), F.col("worth"))), F.lit(0.0)).alias("open"), F.first("reached").alias("reached"))
    total = unread.groupBy("query_id").agg(F.sum("open").alias("all_open"), F.first("reached").alias("reached"))
    found = _read(needed.filter("read").select("query_id", "phrase", "slot"), index, long)
    found = found.join(F.broadcast(asked), ["query_id", "phrase"]).join(F.broadcast(unread.select("query_id", "phrase", "open")), ["query_id", "phrase"])
    known = found.groupBy("query_id", "claim_id").agg(F.sum(F.col("factor") * F.col("weight") - F.col("open")).alias("known"))
    known = known.join(F.broadcast(total), "query_id")
    return known.filter(F.coalesce(F.col("known") + F.col("all_open") + MARGIN >= F.col("reached"), F.lit(True))).select("query_id", "claim_id")


@in_blocks
def bm25(questions: DataFrame, claims: DataFrame, limit: int, index: Index | None = None) -> DataFrame:
    """query_id, claim_id, bm25, rank of the best claims with any word or phrase asked for.

    The first candidates give a score that the last of the best reaches at least; blocks below it are skipped, and of
    the claims in the others only those that may reach it are scored.  All of them count: the result is exact.
    Without an index all claims are scored in one pass, which costs less for one block of questions than to build it.
    """
    if index is None:
        found = matching.full_text(asked_phrases(questions), claims, tokens(F.lower(F.coalesce("claim_text", F.lit("")))), limit, weight)
        return ranked(found, "bm25", limit).select("query_id", "claim_id", "bm25", "rank")
    asked, blocks, long, seeds = _plan(questions, claims, index, limit)
    needed = keep(_needed(asked, blocks, seeds, limit), "blocks")
    pairs = _candidates(needed, index, long, asked)
    return ranked(_exact(pairs, asked, index, long), "bm25", limit).select("query_id", "claim_id", "bm25", "rank")


def block_report(questions: DataFrame, claims: DataFrame, limit: int, index: Index | None = None) -> DataFrame:
    """query_id, blocks, skipped, postings, skipped_postings: what a full-text search of each question leaves unread."""
    index = index or build_index(claims)
    asked, blocks, _, seeds = _plan(questions, claims, index, limit)
    needed = _needed(asked, blocks, seeds, limit)
    unread = lambda c: F.sum(F.when(F.col("read"), 0).otherwise(c))
    return needed.groupBy("query_id").agg(F.count("*").alias("blocks"), unread(1).alias("skipped"), F.sum("n").alias("postings"), unread(F.col("n")).alias("skipped_postings"))
