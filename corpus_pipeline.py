"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm import decontamination, ngram_join, packing, scratch, secret_ledger, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with _key, and those an operator gets, whose doc_id it is: a row without an id is known by its text.

    Such keys are 2**62 or more, so of linked rows one with an id is the smallest.
    """
    content = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), content))
    return rows, rows.withColumn("doc_id", F.col("_key")).drop("_key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at 0.5 or more go; all rows of a doc_id are judged by its highest score, rows without one by text."""
    rows, named = _keyed(docs)
    scored = toxicity.score(spark, named, _read(spark, sf_dir, "labels"))
    bad = scored.filter(F.col("predicted") == 1).select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(bad, "_key", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, with the smallest doc_id, one without an id only if none has one.

    Texts under one doc_id are documents of their own: all but one of them are compared under a number that is made of
    id and text, and count as that id.  Rows without words are linked with nothing and stay, repeated ones too.
    """
    rows, _ = _keyed(docs)
    rows = rows.withColumn("_same", F.xxhash64("text"))
    repeated = rows.groupBy("_key").agg(F.min("_same").alias("_first"), F.max("_same").alias("_last")).filter("_first < _last")
    repeated = scratch.write(spark, repeated.select("_key", "_first"), "repeated")
    number = F.shiftrightunsigned(F.xxhash64("_key", "_same"), 3).bitwiseOR(F.lit(1 << 61))
    rows = rows.join(repeated, "_key", "left").withColumn("_id", F.when(F.col("_first") != F.col("_same"), number).otherwise(F.col("_key")))
    grouped = ngram_join.near_components(spark, rows.select(F.col("_id").alias("doc_id"), "text"))
    members = grouped.groupBy("doc_id", "component_id").agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    known = rows.filter(F.col("_id") != F.col("_key")).select(F.col("_id").alias("doc_id"), "_key").distinct()
    members = members.join(known, "doc_id", "left")
    first = F.struct(F.coalesce("_key", "doc_id").alias("key"), "doc_id", "n", "rows")
    kept = members.groupBy("component_id").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("_id"), ((F.col("k.n") > 0) & (F.col("k.rows") > 1)).alias("_once"))
    rows = rows.join(scratch.write(spark, kept, "kept"), "_id")
    return rows.filter("NOT _once").select(docs.columns).unionByName(rows.filter("_once").dropDuplicates(["_id"]).select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go.

    Texts of one doc_id go together, rows without an id by their text; null and empty texts have no words and stay, and
    long ones are judged whole.
    """
    rows, named = _keyed(docs)
    found = decontamination.contamination(spark, named, _read(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(bad, "_key", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced, and n_chars follows the text.

    Null and empty texts stay as they are, long ones are scanned whole; rows are matched by id, null or not, and content.
    """
    clean = secret_ledger.redact(docs, secret_ledger.scan(spark, docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a null or empty text is its end id, a long one is cut; see packing.pack."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has neither the nearest-example scores nor the tokenizer; the tests of each operator hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
