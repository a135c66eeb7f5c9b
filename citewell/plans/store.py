"""Tables that later steps read more than once, in the folder that the cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Questions of a block, and bytes of all their columns: what a retriever broadcasts of them is bounded by these.
BLOCK, BLOCK_BYTES = 20_000, 16_000_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own only where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        known = tempfile.mkdtemp(prefix="citewell-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Spark's setting that removes the shuffle files of a statement at its end, by version.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame once as Parquet and returns it as read again, so that its plan is not run for every use.

    Nothing reads the shuffle files of the plan again, so they go with the write instead of at some later collection.
    """
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in CLEANUP}
    try:
        for key in CLEANUP:
            spark.conf.set(key, "true")
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    back = spark.read.schema(frame.schema).parquet(path)
    back.kept_path = path
    return back


def _path(spark: SparkSession, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def version(frame: DataFrame) -> tuple:
    """What tells a table of files from what it was before: its files, their size and when their folders last changed."""
    files = sorted(frame.inputFiles())
    spark, state = frame.sparkSession, []
    for name in sorted({f.rsplit("/", 1)[0] for f in files}):
        where, system = _path(spark, name)
        state.append((name, system.getFileStatus(where).getModificationTime(), system.getContentSummary(where).getLength()))
    return hash(tuple(files)), *state


_REMEMBERED: dict[tuple, tuple[object, list[str]]] = {}


def remembered(spark: SparkSession, name: str, tables: list[DataFrame], make: Callable[[], object], frames: Callable[[object], list[DataFrame]] = lambda x: [x]):
    """What ``make`` keeps for these tables, made once in an application as long as they and what was kept are there."""
    key = (spark.sparkContext.applicationId, folder(spark), name, *map(version, tables))
    if key in _REMEMBERED:
        made, paths = _REMEMBERED[key]
        if all(system.exists(where) for where, system in (_path(spark, p) for p in paths)):
            return made
    made = make()
    _REMEMBERED[key] = made, [f.kept_path for f in frames(made)]
    return made


def _bytes(frame: DataFrame):
    """What the strings and arrays of a row come to."""
    total = F.lit(0).cast("long")
    for name, kind in frame.dtypes:
        if kind == "string":
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(name, "")) + 8 * F.size(name), F.lit(0))
        elif kind.startswith("array<"):
            total = total + 8 * F.greatest(F.size(name), F.lit(0))
    return total


def in_blocks(retrieve: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A retriever over questions (query_id, ...) that broadcasts them: many, or long ones, are answered in blocks of bounded size."""

    @functools.wraps(retrieve)
    def run(questions: DataFrame, *rest, **options) -> DataFrame:
        count, size = questions.agg(F.count("*"), F.coalesce(F.sum(_bytes(questions)), F.lit(0))).first()
        parts = max(-(-count // BLOCK), -(-size // BLOCK_BYTES))
        if parts <= 1:
            return retrieve(questions, *rest, **options)
        block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        answers = [retrieve(questions.filter(block == part), *rest, **options) for part in range(parts)]
        return functools.reduce(DataFrame.unionByName, answers)

    return run
