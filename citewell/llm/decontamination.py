"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of every ``size - k + 1`` consecutive k-grams the one whose first word has the
smallest hash is kept, and hashed whole, so any window of ``size`` words leaves at
least one fingerprint, the same on both sides.  Documents' and items'
fingerprints are joined, and each hit is extended by comparing the words of all
windows that hold it.  Items of fewer words than a window are one window each;
all their lengths are looked up in one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

#: Words of a window and of a fingerprint; a span of SIZE shared words is never missed.
SIZE, K = 13, 7
#: Words of a text that are worked on as one row; the rest overlaps by a window less one word.
PIECE = 2000
#: Bytes of keys, fingerprints or item texts up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 32_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_POS = 12  # bits for a place in a piece
_PRINTS = "array<struct<hash:bigint,pos:int>>"


def words(text: Column) -> Column:
    """Lower-cased words; null has none.  Separators become blanks: splitting at a plain character needs no regex."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _OTHERS, _LOWER + " " * len(_OTHERS))
    return F.array_remove(F.split(plain, " ", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, where the optimizer would copy it into every lambda."""
    return F.transform(F.array(value), body)[0]


def pieces(rows: DataFrame, reach: int) -> DataFrame:
    """base: where slices of PIECE words start, which overlap so that any ``reach`` words lie whole in one."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - reach), F.lit(PIECE - reach + 1))
    return rows.withColumn("base", F.explode(at))


def piece() -> Column:
    return F.slice("words", F.col("base") + 1, F.lit(PIECE))


def _shifted_least(step: int) -> Callable[[Column], Column]:
    """Each element or the one ``step`` further, whichever is less."""
    return lambda m: F.zip_with(m, F.slice(m, step + 1, F.size(m)), lambda x, y: F.least(x, y))


def _grams(lengths: list[int]) -> Callable[[Column], Column]:
    """pos, gram of all runs of these lengths; fewer words than a length are one run."""

    def runs(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.struct(i.alias("pos"), F.slice(w, i, n).alias("gram")))

    return lambda w: F.concat(*[runs(w, n) for n in lengths])


def _prints(w: Column) -> Column:
    """hash, pos (in the piece, from 1) of the smallest of every SIZE - K + 1 consecutive k-grams.

    K-grams are ordered by the hash of their first word, equal ones by place, so a window's words alone decide;
    only the chosen ones are hashed whole.  A sliding minimum is made by doubling.
    """
    place = (1 << _POS) - 1
    minimum = F.transform(w, lambda x, i: F.shiftleft(F.shiftright(F.xxhash64(x), _POS), _POS).bitwiseOR(i.cast("long")))
    reach, wide = SIZE - K + 1, 1
    while wide < reach:
        step = min(wide, reach - wide)
        minimum = let(minimum, _shifted_least(step))
        wide += step
    chosen = F.array_distinct(F.slice(minimum, F.lit(1), F.size(w) - (SIZE - 1)))
    pos = lambda x: x.bitwiseAND(F.lit(place)).cast("int") + 1
    return F.transform(chosen, lambda x: F.struct(F.xxhash64(F.slice(w, pos(x), K)).alias("hash"), pos(x).alias("pos")))


def fingerprints(cut: DataFrame) -> DataFrame:
    """Adds prints to the slices of ``pieces``; none for fewer words than a window."""
    return cut.withColumn("prints", F.when(F.size("words") >= SIZE, let(piece(), _prints)).otherwise(F.array().cast(_PRINTS)))


def _sized(small: DataFrame, held: str | None = None) -> DataFrame:
    """Broadcast if its bytes are few: some 64 a row and the strings of the array ``held``."""
    size = F.lit(64) + (F.octet_length(F.array_join(held, "")) + 16 * F.size(held) if held else F.lit(0))
    return F.broadcast(small) if (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else small


def _hits(spark: SparkSession, rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, sum, n_words, at, item_id, i_at of equal fingerprints, and a row without an item for each row."""
    prints = fingerprints(pieces(items, SIZE)).select("item_id", "base", F.explode("prints").alias("p"))
    known = _sized(prints.select(F.col("p.hash").alias("hash"), "item_id", (F.col("base") + F.col("p.pos")).alias("i_at")).distinct())
    none = F.when(F.col("base") == 0, F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(0).alias("pos")))).otherwise(F.array().cast(_PRINTS))
    cut = fingerprints(pieces(rows, SIZE)).select("doc_id", "sum", F.size("words").cast("long").alias("n_words"), "base", F.explode(F.concat(none, "prints")).alias("p"))
    cut = cut.select("doc_id", "sum", "n_words", F.col("p.hash").alias("hash"), (F.col("base") + F.col("p.pos")).alias("at"))
    found = cut.join(known, "hash", "left").filter(F.col("item_id").isNotNull() | F.col("hash").isNull())
    return scratch.write(spark, found.drop("hash"), "hits")


def _extended(rows: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, sum, item_id, start, len of the windows over a hit whose words are equal on both sides.

    Hits come to a text by stretches of PIECE words, so no row gathers all hits of a long text.
    """
    hit = hits.filter(F.col("item_id").isNotNull())
    stretch = F.floor(F.col("at") / PIECE).alias("stretch")
    mine = hit.groupBy("doc_id", "sum", stretch).agg(F.collect_set(F.struct("item_id", "at", "i_at")).alias("hits"))
    keys = _sized(hit.select("doc_id", "sum").distinct())
    texts = rows.join(keys, ["doc_id", "sum"], "left_semi")
    both = texts.join(mine, ["doc_id", "sum"]).select("doc_id", "sum", "words", F.explode("hits").alias("hit"))
    both = both.select("doc_id", "sum", "hit.*", F.slice("words", F.greatest(F.lit(1), F.col("hit.at") - (SIZE - K)), F.lit(2 * SIZE - K)).alias("around"))
    both = both.join(_sized(items.select("item_id", F.col("words").alias("i_words")), "i_words"), "item_id")
    left = F.least(F.lit(SIZE - K), F.col("at") - 1)
    part = lambda o: F.slice("around", left - o + 1, F.lit(SIZE))
    same = F.filter(F.sequence(F.lit(0), F.least(left, F.col("i_at") - 1)), lambda o: (F.size(part(o)) == SIZE) & (part(o) == F.slice("i_words", F.col("i_at") - o, F.lit(SIZE))))
    return both.select("doc_id", "sum", "item_id", "at", F.explode(same).alias("o")).select("doc_id", "sum", "item_id", (F.col("at") - F.col("o")).cast("long").alias("start"), F.lit(SIZE).alias("len"))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, sum, n_words, n_hit, items, contaminated for every row of documents(doc_id, text) against benchmark(item_id, text).

    n_hit counts the words inside any occurrence of an item's window; items has the ids of items with occurring
    windows, sorted as strings.  Null and empty texts have no words and no hits; ids may be null or negative.
    Rows with the same id and text are alike; rows with the same id and other texts are told apart by ``sum``, the
    text's hash, whose lowest bit says that the id is null.  Extra columns are ignored.  Items with the same id and other texts count as that one item.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("name"), words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    items = items.withColumn("item_id", F.xxhash64("name", "words"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lost = F.col("doc_id").isNull().cast("long")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(lost).alias("sum"), words(F.col("text")).alias("words"))
    hits = _hits(spark, rows, items.filter(F.size("words") >= SIZE))
    found = _extended(rows, hits, items)

    short = items.filter(F.size("words") < SIZE)
    lengths = sorted(r.n for r in short.select(F.size("words").alias("n")).distinct().collect())  # twelve at most
    if lengths:
        known = _sized(short.select("item_id", F.col("words").alias("gram")), "gram")
        near = pieces(rows.filter(F.size("words") >= lengths[0]), lengths[-1]).select("doc_id", "sum", "base", F.explode(let(piece(), _grams(lengths))).alias("g"))
        near = near.select("doc_id", "sum", "g.gram", (F.col("base") + F.col("g.pos")).cast("long").alias("start")).join(known, "gram")
        found = found.unionByName(near.select("doc_id", "sum", "item_id", "start", F.size("gram").alias("len")))
    found = scratch.write(spark, found.join(_sized(items.select("item_id", "name")), "item_id"), "windows")
    return _covered(hits.filter(F.col("item_id").isNull()), found)


def _covered(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Per row the words under the union of its windows: each start's own part beyond the furthest end so far."""
    key = ["doc_id", "sum"]
    ordered = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = windows.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    gain = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(ordered), F.lit(0))))
    hit = ends.withColumn("gain", gain).groupBy(*key).agg(F.sum("gain").cast("long").alias("n_hit"))
    names = windows.select(*key, "name").distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.col("name").cast("string"))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(*key, "n_words").join(hit.join(names, key, "left"), key, "left").select(
        F.when(F.col("sum").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("doc_id"), "sum", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _sql_words(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SEPARATORS}'), lambda x: x <> '') AS w FROM {table}"


SQL = f"""
WITH d AS ({_sql_words("documents", "doc_id")}), b AS ({_sql_words("benchmark", "item_id")}),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
  SELECT item_id, w, least(len(w), {SIZE}) AS m, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
