"""What questions ask for, and where it occurs.

Questions are a stated set with the features of ``query_terms.analyze``; their
terms are broadcast in blocks of bounded bytes, and claims stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: What a matched term adds by the first kind it is of, and most for all terms together.
EXPANDED, TEXT, EXACT, CATALOG, OTHER, MOST = 0.25, 0.2, 0.2, 0.05, 0.03, 1.0
KINDS = ["text_terms", "expanded_terms", "catalog_terms", "ngrams", "exact_spans", "symbol_spans", "formula_spans"]


def listed(questions: DataFrame, kinds: list[str]) -> Column:
    """The terms of these kinds that the questions have, each once, in order."""
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[c for c in kinds if c in questions.columns]))


def searchable(questions: DataFrame) -> Column:
    """What full text and substrings are searched for."""
    return listed(questions, ["text_terms", "expanded_terms", "catalog_terms", "formula_spans"])


def all_terms(questions: DataFrame) -> Column:
    return listed(questions, KINDS)


def spans(questions: DataFrame) -> Column:
    return listed(questions, ["exact_spans", "formula_spans", "symbol_spans"])


def weight_of(questions: DataFrame, term: Column) -> Column:
    """What a matched term adds to a score of its question."""
    has = lambda *kinds: F.array_contains(listed(questions, list(kinds)), term)
    text, catalog = has("text_terms"), has("catalog_terms")
    known = F.when(has("expanded_terms"), EXPANDED).when(text & ~catalog, TEXT).when(has("formula_spans", "symbol_spans"), EXACT)
    return known.when(catalog, CATALOG).when(F.length(term) >= 2, OTHER).otherwise(0.0)


def asked_terms(questions: DataFrame, terms: Column) -> DataFrame:
    """query_id, term (lower case), weight (of all its spellings), times (how many)."""
    rows = questions.withColumn("term", F.explode(terms)).filter(F.trim("term") != "")
    rows = rows.select("query_id", F.lower("term").alias("term"), weight_of(questions, F.col("term")).alias("weight"))
    return rows.groupBy("query_id", "term").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("times"))


def ranked(rows: DataFrame, by: str, limit: int | None, key: tuple[str, ...] = ("query_id",), name: str = "rank", tie: str = "claim_id") -> DataFrame:
    """The best ``limit`` rows of each key, or all, numbered from 1."""
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(by), tie)))
    return rows if limit is None else rows.filter(F.col(name) <= limit)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as shuffles have: they are few bytes and much work, so tasks are not to be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_automata: dict[int, tuple[ahocorasick.Automaton, list[str]]] = {}


def _automaton(shared: Broadcast) -> tuple[ahocorasick.Automaton, list[str]]:
    """A worker's automaton of the broadcast terms; only the last one is held."""
    name = id(shared.value)
    if name not in _automata:
        made = ahocorasick.Automaton()
        for n, term in enumerate(shared.value):
            made.add_word(term, n)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made, shared.value
    return _automata[name]


def holding(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Rows whose ``text`` holds a term, once for each, joined with the columns of terms(term, ...) and dealt by ``key``.

    The terms are those of a block of questions.  Each text is read once by an automaton of all terms, which
    column functions cannot express; it is the only step outside of the JVM, and hands back the found terms of a row.
    """
    spark = rows.sparkSession
    listed = sorted(r.term for r in terms.select("term").distinct().collect() if r.term)
    columns = [c for c in rows.columns if c != "text"]
    if not listed:
        return rows.drop("text").join(F.broadcast(terms), F.lit(False))
    shared = spark.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = _automaton(shared)
        for batch in batches:
            found = [sorted({n for _, n in made.iter(text)}) if text else [] for text in batch.column("text").to_pylist()]
            at = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            lists = pa.array([[names[n] for n in x] for x in found if x], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), lists], [*columns, "terms"])

    schema = StructType([*[rows.schema[c] for c in columns], StructField("terms", ArrayType(StringType()))])
    found = dealt(rows.select(*columns, "text").mapInArrow(run, schema), key)
    return found.select(*columns, F.explode("terms").alias("term")).join(F.broadcast(terms), "term")


def relevance(base: float | Column, bonus: Column) -> Column:
    """The base and what the matched terms add to it, one point at most."""
    base = F.lit(base) if isinstance(base, float) else base
    return F.round(base + F.least(bonus, F.lit(MOST)), 6)


def matched_bonus(text: Column, asked: Column) -> Column:
    """What those of the asked terms (term, weight) add that occur in a text; the text is put in lower case once."""
    add = lambda low: F.aggregate(asked, F.lit(0.0), lambda s, t: s + F.when(F.contains(low, t["term"]), t["weight"]).otherwise(0.0))
    return F.transform(F.array(F.lower(text)), add)[0]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
