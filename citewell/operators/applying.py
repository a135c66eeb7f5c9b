"""A staged run becomes part of the catalog: references resolved, relations replaced, pages listed.

Every step takes relations and returns the next version of one, so a run that
fails half way has changed nothing: callers write all versions, then use them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import Catalog
from .upsert import insert_ignore, page_references, replace_children, upsert

#: Sections of the index page and what an empty one says.
HEADINGS = {"source": "Sources", "concept": "Concepts", "entity": "Entities", "synthesis": "Syntheses"}


def resolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with both ends as page ids, and ``unknown``: the first end that names no page by id or path, else null."""
    ends = page_references(pages)
    side = lambda name: ends.select(F.col("ref").alias(f"{name}_page"), F.col("page_id").alias(f"{name}_id"))
    rows = links.join(side("from"), "from_page", "left").join(side("to"), "to_page", "left")
    unknown = F.when(F.col("from_id").isNull(), F.col("from_page")).when(F.col("to_id").isNull(), F.col("to_page"))
    return rows.select(F.coalesce("from_id", "from_page").alias("from_page"), F.coalesce("to_id", "to_page").alias("to_page"), "link_type", unknown.alias("unknown"))


def appended_relationships(old: DataFrame, new: DataFrame, source_id: Column) -> DataFrame:
    """Old and new rows, repeats included; a new row without evidence has an empty one, without source the run's."""
    filled = new.withColumn("evidence_claim_id", F.coalesce("evidence_claim_id", F.lit(""))).withColumn("source_id", F.coalesce(F.when(F.col("source_id") != "", F.col("source_id")), source_id))
    return old.unionByName(filled.select(old.columns))


def finished_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs (run_id, source_id, status, created_at, applied_at) after some (run_id, source_id, at) were applied; a known run keeps its source and creation."""
    both = runs.join(done.select("run_id", F.col("source_id").alias("new_source"), "at"), "run_id", "full_outer")
    return both.select(
        "run_id", F.coalesce("source_id", "new_source").alias("source_id"), F.when(F.col("at").isNotNull(), "applied").otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", "at").alias("created_at"), F.coalesce("at", "applied_at").alias("applied_at"),
    )


def page_aliases(patches: DataFrame) -> DataFrame:
    """alias, target_type, target_id, normalized_alias of patches (page_id, page_type, title, aliases array): the title first, each form once."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = patches.select(F.posexplode(names).alias("place", "alias"), F.col("page_type").alias("target_type"), F.col("page_id").alias("target_id"))
    rows = rows.withColumn("normalized_alias", T.normalize_alias(F.col("alias")))
    first = F.row_number().over(Window.partitionBy("target_id", "normalized_alias").orderBy("place"))
    return rows.withColumn("_n", first).filter(F.col("_n") == 1).select("alias", "target_type", "target_id", "normalized_alias")


def apply_run(catalog: Catalog, claims: DataFrame, patches: DataFrame, links: DataFrame, relationships: DataFrame, source_id: str, at: str) -> Catalog:
    """The catalog after a run: claims (first writer wins), pages, aliases and links of its patches (replaced), relationships (appended).

    patches (page_id, page_type, title, target_path, aliases array<string>); links (from_page, to_page, link_type)
    by id or path.  A link that names no page of the catalog or the run raises ValueError, and nothing is changed.
    """
    paged = patches.select("page_id", F.col("target_path").alias("path"), "page_type", "title", F.to_json("aliases").alias("aliases"), F.lit(at).alias("updated_at"))
    pages = upsert(catalog.pages, paged, "page_id")
    ends = resolved_links(links, pages)
    if lost := ends.filter(F.col("unknown").isNotNull()).select("unknown").first():
        raise ValueError(f"link to an unknown page: {lost.unknown}")
    aliases = replace_children(catalog.aliases, page_aliases(patches).select(catalog.aliases.columns), "target_id", "normalized_alias", "alias")
    old_links = catalog.links.join(patches.select(F.explode(F.array("page_id", "target_path")).alias("from_page")).distinct(), "from_page", "left_anti").select(catalog.links.columns)
    known = [c for c in catalog.claims.columns if c in claims.columns or c == "created_at"]
    added = insert_ignore(catalog.claims.select(known), claims.withColumn("created_at", F.lit(at)).select(known), "claim_id")
    return replace(
        catalog, claims=added, pages=pages, aliases=aliases, links=old_links.unionByName(ends.select(catalog.links.columns)),
        relationships=appended_relationships(catalog.relationships, relationships, F.lit(source_id)),
    )


def index_lines(pages: DataFrame) -> DataFrame:
    """section, place, line of the index page: a heading for each page type, its pages by title, then path, or a line that there are none.

    Lines are rows, to be ordered by section and place when written: an index never has to fit a task.
    """
    order = {kind: i for i, kind in enumerate(HEADINGS)}
    spark = pages.sparkSession
    heads = spark.createDataFrame([(order[k], k, name) for k, name in HEADINGS.items()], "section int, page_type string, name string")
    listed = pages.filter(F.col("page_type").isin(*HEADINGS)).select("page_type", F.concat_ws("\u0000", "title", "path").alias("place"), F.concat(F.lit("- [["), "path", F.lit("|"), "title", F.lit("]]")).alias("line"))
    none = heads.join(pages.select("page_type").distinct(), "page_type", "left_anti").select("section", F.lit("").alias("place"), F.concat(F.lit("No "), F.lower("name"), F.lit(" applied yet.")).alias("line"))
    top = heads.select("section", F.lit(None).cast("string").alias("place"), F.concat(F.lit("## "), "name").alias("line"))
    return top.unionByName(none).unionByName(listed.join(F.broadcast(heads.select("section", "page_type")), "page_type").select("section", "place", "line"))


def log_lines(runs: DataFrame) -> DataFrame:
    """run_id, line of the log for runs (run_id, source_id, at, claims, patches)."""
    line = F.format_string("- %s Applied ingest run `%s` for source `%s` (%d claims, %d patches).", "at", "run_id", F.coalesce("source_id", F.lit("unknown")), "claims", "patches")
    return runs.select("run_id", line.alias("line"))


def canonical_locators(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Claims whose locator is replaced by the full anchor of the line it names, empty where the source has no such line.

    anchors(source_id, line, locator); the confidence follows from the new locator.
    """
    line = F.regexp_extract(F.coalesce("citation_locator", F.lit("")), r"line:(\d+)", 1)
    rows = claims.withColumn("_line", F.when(line != "", line.cast("bigint")))
    named = anchors.select("source_id", F.col("line").cast("bigint").alias("_line"), F.col("locator").alias("_locator"))
    joined = rows.join(named, ["source_id", "_line"], "left").withColumn("citation_locator", F.coalesce("_locator", F.lit("")))
    return joined.withColumn("confidence_status", T.confidence(F.col("citation_locator"), F.col("confidence_status"))).select(claims.columns)
