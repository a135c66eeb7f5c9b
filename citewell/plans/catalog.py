"""The catalog's relations: their schemas, and how they derive from documents and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.query_terms import analyze
from ..sources import documents as D
from .store import keep

#: Relations and columns of the catalog, all strings.
SCHEMAS = {
    "sources": "source_id, title, source_type, raw_path, normalized_path, sha256, url, imported_at, status",
    "claims": "claim_id, source_id, claim_text, citation_locator, confidence_status, created_at",
    "aliases": "alias, target_type, target_id, normalized_alias",
    "pages": "page_id, path, page_type, title, aliases, updated_at",
    "links": "from_page, to_page, link_type",
    "relationships": "subject_id, object_id, relationship_type, evidence_claim_id, source_id",
    "ingest_runs": "run_id, source_id, status, created_at, applied_at",
}
CREATED = "2026-01-01T00:00:00+00:00"


def schema(name: str) -> StructType:
    return StructType.fromDDL(", ".join(f"{c} string" for c in SCHEMAS[name].split(", ")))


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema(name)) for name in SCHEMAS}


def problems(relations: dict[str, DataFrame]) -> list[str]:
    """Missing relations and relations whose columns or their order differ."""
    missing = [f"missing {name}" for name in SCHEMAS if name not in relations]
    return missing + [f"{name} has {', '.join(relations[name].columns)}" for name in SCHEMAS if name in relations and relations[name].columns != SCHEMAS[name].split(", ")]


@dataclass
class Catalog:
    sources: DataFrame
    claims: DataFrame
    aliases: DataFrame
    pages: DataFrame
    links: DataFrame
    relationships: DataFrame


def from_documents(docs: DataFrame, labels: DataFrame, stored: bool = False) -> Catalog:
    """A catalog whose confidence comes from quality labels, contradictions from toxic ones, concepts from language and source.

    Stored: all relations are written once, for plans that use them again and again.
    """
    sources = D.import_sources(docs)
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sources = sources.join(marks, "doc_id", "left").withColumn("concept_id", F.concat(F.lit("concept:"), F.col("lang"), F.lit("-"), F.col("source")))
    sources = keep(sources, "sources") if stored else sources
    status = F.when(F.col("quality") == 1, "cited").when(F.col("quality") == 0, "weak").otherwise("uncited")
    claims = D.claims(sources).join(sources.select("source_id", status.alias("confidence_status")), "source_id").withColumn("created_at", F.lit(CREATED))
    claims = keep(claims, "claims") if stored else claims
    path = lambda kind, name: F.concat(F.lit(f"wiki/{kind}/"), name, F.lit(".md"))
    concepts = sources.select("concept_id", "lang", "source").distinct()
    concept_title = F.concat_ws(" ", "lang", "source")
    pages = sources.select(F.col("source_id").alias("page_id"), path("sources", F.col("source_id")).alias("path"), F.lit("source").alias("page_type"), "title").unionByName(
        concepts.select(F.col("concept_id").alias("page_id"), path("concepts", T.slugify(concept_title)).alias("path"), F.lit("concept").alias("page_type"), concept_title.alias("title"))
    )
    pages = pages.withColumn("aliases", F.lit("[]")).withColumn("updated_at", F.lit(CREATED))
    alias = concepts.select(F.explode(F.array(concept_title, F.col("lang"), F.col("source"))).alias("alias"), F.lit("concept").alias("target_type"), F.col("concept_id").alias("target_id"))
    aliases = alias.withColumn("normalized_alias", T.normalize_alias(F.col("alias")))
    links = sources.select(F.col("source_id").alias("from_page"), F.col("concept_id").alias("to_page"), F.lit("mentions").alias("link_type")).unionByName(
        sources.select(F.col("concept_id").alias("from_page"), F.col("source_id").alias("to_page"), F.lit("supports").alias("link_type"))
    )
    first = claims.groupBy("source_id").agg(F.min_by("claim_id", "line").alias("evidence_claim_id"))
    kind = F.when(F.col("toxic") == 1, "contradicts").otherwise("supports")
    relationships = sources.join(first, "source_id").select(F.col("concept_id").alias("subject_id"), F.col("source_id").alias("object_id"), kind.alias("relationship_type"), "evidence_claim_id", "source_id")
    small = (aliases, pages, links, relationships)
    if stored:
        small = (keep(x, name) for x, name in zip(small, ("aliases", "pages", "links", "relationships"), strict=True))
    return Catalog(sources, claims, *small)


#: Added to each question, so that synonyms, formulas and symbols are asked for as well.
ASIDE = " 怎么保存 E=mc2 α/β ="


def questions(benchmark: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id, question and its features: each benchmark item asked by its whole text."""
    asked = benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(ASIDE)).alias("question"))
    return analyze(asked, catalog.aliases.select(F.col("alias").alias("term")))
