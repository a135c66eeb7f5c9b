"""Documents in, line-anchored claims out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def source_type(name, content):
    """web, markdown, pdf or text by suffix or magic bytes."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.html?$"), "web").when(low.rlike(r"\.pdf$") | (F.substring(content, 1, 4) == "%PDF"), "pdf").when(low.rlike(r"\.(md|markdown)$"), "markdown").otherwise("text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, text of every file under a path: bytes decoded as UTF-8, line ends as LF, web pages as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    rows = rows.withColumn("source_type", source_type(F.col("name"), F.col("text")))
    web = T.squeeze_blanks(T.unescape_html(T.html_to_text(F.col("text"))))
    return rows.withColumn("text", F.regexp_replace(F.when(F.col("source_type") == "web", web).otherwise(F.col("text")), r"\r\n?", "\n"))


def import_sources(docs: DataFrame) -> DataFrame:
    """source_id, sha256, doc_id, title, text of distinct contents: the first document of each hash stays.

    The hash is grouped without its text, which then joins one row each.
    """
    rows = docs.filter(F.col("text").isNotNull()).withColumn("sha256", F.sha2("text", 256))
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    kept = rows.join(first, ["sha256", "doc_id"]).dropDuplicates(["sha256"])
    named = kept.withColumn("source_id", F.concat(F.lit("src_"), F.substring("sha256", 1, 12)))
    return named.withColumn("title", T.title(F.col("text"), F.lit("Untitled Source")))


def anchored_lines(sources: DataFrame) -> DataFrame:
    """source_id, line, text, section, paragraph of every line: the last heading, and runs of lines with text counted."""
    rows = sources.select("source_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    rows = rows.withColumn("heading", T.heading(F.col("text"))).withColumn("body", F.col("heading").isNull() & F.col("text").rlike(r"\S"))
    order = Window.partitionBy("source_id").orderBy("line")
    starts = F.col("body") & ~F.coalesce(F.lag("body").over(order), F.lit(False))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last("heading", True).over(so_far)).withColumn("paragraph", F.sum(starts.cast("int")).over(so_far).cast("int"))
    return rows.select("source_id", "line", "text", "section", F.when(F.col("body"), F.col("paragraph")).alias("paragraph"))


def claims(sources: DataFrame) -> DataFrame:
    """claim_id, source_id, claim_text, citation_locator, line of the lines that state something."""
    rows = anchored_lines(sources).filter(T.is_claim(F.col("text")))
    locator = F.concat_ws(";", F.concat(F.lit("line:"), F.col("line")), F.concat(F.lit("section:"), F.col("section")), F.concat(F.lit("paragraph:"), F.col("paragraph")))
    return rows.select(F.concat_ws("_", F.lit("clm"), "source_id", F.col("line").cast("string")).alias("claim_id"), "source_id", T.strip(F.col("text")).alias("claim_text"), locator.alias("citation_locator"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of the text files under a path, which Spark splits into ranges of bytes, however long a file is.

    A line's number is its place within its range, as rows of a range are read in order by one task, and the lines of the
    ranges before it: only one count of each range is summed up.  Lines end with a line feed.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select("value", *meta, F.monotonically_increasing_id().alias("place"))
    ranges = rows.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("start")) - F.col("lines")
    ranges = ranges.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(ranges, ["file", "start"]).select("file", (F.col("place") + F.col("shift")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with file name and line number; blank lines are left out, those that hold no JSON object have ``error``.

    A file is read in ranges, so it may be of any length; see ``numbered_lines``.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema + ", _corrupt string")
    lines = numbered_lines(spark, path).filter(T.strip(F.col("value")) != "")
    parsed = lines.withColumn("row", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    error = F.when(F.col("row._corrupt").isNotNull(), F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("line"), F.lit(": not JSON")))
    return parsed.select("file", "line", error.alias("error"), *[F.col(f"row.{f.name}") for f in kind if f.name != "_corrupt"])


#: What is kept of a staged run, and its columns.
STAGED = {
    "claims": "run_id string, claim_id string, source_id string, claim_text string, citation_locator string, confidence_status string, created_at string",
    "patches": "run_id string, action string, page_id string, page_type string, title string, target_path string, content string, claim_ids array<string>",
    "manifests": "run_id string, source_id string, status string, created_at string",
}


def write_staged(staged: dict[str, DataFrame], path: str) -> None:
    """Claims, patches and manifests of staged runs as JSON lines, a folder for each; nulls are written too."""
    for name, rows in staged.items():
        columns = [part.split(" ")[0] for part in STAGED[name].split(", ")]
        rows.select(columns).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def read_staged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each relation of ``write_staged`` with file, line and error; a line that is broken has nothing else."""
    return {name: read_json_lines(spark, f"{path}/{name}", schema) for name, schema in STAGED.items()}


def write_pages(pages: DataFrame, path: str) -> None:
    """Page contents as Markdown text, a folder for each page type."""
    pages.select("page_type", F.col("content").alias("value")).write.mode("overwrite").partitionBy("page_type").text(path)
