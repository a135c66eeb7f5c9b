"""Planned questions and their answers: how a plan is run, what became of an answer, and the page it is kept on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query_terms import analyze
from ..plans.store import keep
from . import retrieval, selection

#: Coverages that ask for one thing at a time, and keys that only retrieval may fill.
EACH = ("per_entity", "per_source", "multiple_sources")
EVIDENCE_KEYS = ("claim_id", "citation_locator", "page_path", "score")


def planned_mode(plans: DataFrame) -> DataFrame:
    """plan_id, mode: focused for plans (plan_id, intent, subqueries, coverages array) that compare or have several parts, else null."""
    intent = F.lower(F.coalesce("intent", F.lit("")))
    each = F.exists(F.coalesce("coverages", F.array().cast("array<string>")), lambda c: F.lower(c).isin(*EACH))
    focused = (F.col("subqueries") > 1) | F.contains(intent, F.lit("compar")) | F.contains(intent, F.lit("比较")) | each
    return plans.select("plan_id", F.when(focused, F.lit("focused")).alias("mode"))


def merged_filters(subqueries: DataFrame, asked: DataFrame) -> DataFrame:
    """Subqueries (plan_id, place, source_id, page_type, confidence) whose empty filters are the question's (plan_id, ...)."""
    names = ("source_id", "page_type", "confidence")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = subqueries.join(asked.select("plan_id", *[F.col(c).alias(f"_{c}") for c in names]), "plan_id", "left")
    return rows.select("plan_id", "place", *[F.coalesce(given(c), given(f"_{c}")).alias(c) for c in names])


def execute_plans(plans: DataFrame, subqueries: DataFrame, asked: DataFrame, catalog, limit: int = 8, pool: int = 80, vectors: DataFrame | None = None, index=None) -> tuple[DataFrame, DataFrame]:
    """All subqueries of all plans retrieved in one batch, each with its own filters: the plans' contexts and their steps.

    plans(plan_id, intent, coverages), subqueries(plan_id, place, query, purpose, source_id, page_type, confidence), asked
    (plan_id and the three filters, which count where a subquery's are empty); vectors are hits (plan_id, place,
    chunk_id, score).  Contexts are those of ``selection.merge_planned`` with purposes and reasons; steps are plan_id,
    place, mode, context_count and the filters of each subquery.  A null query finds nothing and is a step all the same.
    """
    key = F.concat_ws(":", "plan_id", "place").alias("query_id")
    wanted = keep(merged_filters(subqueries, asked).select("plan_id", "place", key, "source_id", "page_type", "confidence"), "filters")
    rows = subqueries.select(key, "plan_id", "place", F.coalesce("query", F.lit("")).alias("question"), F.coalesce("purpose", F.lit("")).alias("purpose"))
    questions = keep(analyze(rows.select("query_id", "question"), catalog.aliases.select(F.col("alias").alias("term"))), "questions")
    hits = None if vectors is None else vectors.select(key, "chunk_id", "score")
    found = retrieval.hybrid(questions, catalog, pool, pool, hits, {"each": retrieval.filters_of(wanted)}, index=index)

    many = rows.groupBy("plan_id").agg(F.count("*").alias("subqueries"))
    forced = planned_mode(plans.join(many, "plan_id", "left").withColumn("subqueries", F.coalesce("subqueries", F.lit(0))))
    related = selection.related(found, catalog.relationships).filter(F.col("relationship_type") == "contradicts")
    against = related.select("query_id").distinct().withColumn("_against", F.lit(True))
    modes = wanted.join(forced.withColumnRenamed("mode", "_forced"), "plan_id", "left").join(questions.select("query_id", "catalog_terms"), "query_id").join(against, "query_id", "left")
    chosen = selection.mode(F.col("catalog_terms"), F.coalesce("_against", F.lit(False)), F.col("_forced"), F.col("source_id"))
    modes = keep(modes.select("query_id", chosen.alias("mode")), "modes")

    evidence = related.filter(F.col("evidence_claim_id") == F.col("claim_id")).select("query_id", "claim_id", F.lit(True).alias("contradiction")).distinct()
    scored = selection.reranked(found).join(evidence, ["query_id", "claim_id"], "left").withColumn("contradiction", F.coalesce("contradiction", F.lit(False)))
    selected = keep(selection.select_evidence(scored.join(modes, "query_id"), limit).select("query_id", "rank", "claim_id", "rerank_score", "reasons"), "selected")
    parts = selected.join(rows, "query_id").join(many, "plan_id")
    contexts = selection.merge_planned(
        parts.select("plan_id", F.col("place").alias("subquery"), "subqueries", "rank", "claim_id", F.col("rerank_score").alias("score"), F.col("question").alias("query"), "purpose", "reasons"), limit
    )
    count = selected.groupBy("query_id").agg(F.count("*").alias("context_count"))
    steps = wanted.join(modes, "query_id").join(count, "query_id", "left").withColumn("context_count", F.coalesce("context_count", F.lit(0)))
    return contexts, steps.select("plan_id", "place", "mode", "context_count", "source_id", "page_type", "confidence")


def forged(plans: DataFrame) -> DataFrame:
    """plan_id, keys: plans (plan_id, reply) that hold keys which only retrieval may fill, at any depth."""
    keys = T.json_keys(F.coalesce(T.bare_object(F.col("reply")), F.lit("")), EVIDENCE_KEYS)
    return plans.select("plan_id", keys.alias("keys")).filter(F.size("keys") > 0)


def answer_status(planned: Column, contexts: Column, replied: Column, problems: Column, citations: Column) -> Column:
    """What became of a question: the first step that failed, else answered.  A failed plan keeps its own status."""
    return (
        F.when(planned != "planned", planned).when(F.coalesce(contexts, F.lit(0)) == 0, "planned_insufficient_evidence").when(~F.coalesce(replied, F.lit(False)), "llm_failed")
        .when((F.coalesce(problems, F.lit(0)) > 0) | (F.coalesce(citations, F.lit(0)) == 0), "invalid_citations").otherwise("answered")
    )


def answer_id(question: Column, answer: Column, claim_ids: Column) -> Column:
    """Eight hex digits that name an answer by question, text and cited claims."""
    return F.substring(F.sha2(F.concat(question, answer, F.array_join(claim_ids, "")), 256), 1, 8)


def synthesis_pages(answers: DataFrame) -> DataFrame:
    """page_id, target_path, source_id, title, links, content of pages that keep answers.

    answers(question, answer, analysis, title, notes array, citations array of struct claim_id, source_id, locator,
    page_path); only those with citations become pages.  The title falls back to the question, analysis to the answer.
    """
    none = F.array().cast("array<string>")
    cited = answers.filter(F.size("citations") > 0)
    ids = F.transform("citations", lambda c: c["claim_id"])
    name = F.coalesce(F.when(T.strip(F.col("title")) != "", T.strip(F.col("title"))), F.when(T.strip(F.col("question")) != "", T.strip(F.col("question"))), F.concat(F.lit("Synthesis "), F.col("answer_id")))
    rows = cited.withColumn("answer_id", answer_id(F.col("question"), F.col("answer"), ids)).withColumn("title", name).withColumn("slug", T.slugify(F.col("title")))
    rows = rows.withColumn("slug", F.when(F.col("slug") == "untitled", F.concat(F.lit("answer-"), "answer_id")).otherwise(F.col("slug")))
    pages = F.array_distinct(F.transform("citations", lambda c: c["page_path"]))
    said = lambda *columns, other: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit(other))
    bullets = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    evidence = F.transform("citations", lambda c: F.concat(F.lit("- `"), c["claim_id"], F.lit("` from `"), c["source_id"], F.lit("` at `"), c["locator"], F.lit("` ([["), c["page_path"], F.lit("]])")))
    notes = F.coalesce("notes", none)
    sections = {
        "Question/Topic": F.array("question"), "Short Answer": F.array(said("answer", other="No answer produced.")), "Evidence": evidence,
        "Analysis": F.array(said("analysis", "answer", other="No analysis produced.")),
        "Uncertainties": F.when(F.size(notes) > 0, bullets(notes)).otherwise(F.array(F.lit("- None identified."))),
        "Related Pages": F.transform("citations", lambda c: F.concat(F.lit("- [["), c["page_path"], F.lit("]]"))),
    }
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), *[x for head, lines in sections.items() for x in (F.lit(f"## {head}"), F.array_join(lines, "\n"))])
    page_id = F.concat(F.lit("synthesis-"), "slug")
    links = F.transform(pages, lambda p: F.struct(page_id.alias("from_page"), p.alias("to_page"), F.lit("supports").alias("link_type")))
    return rows.select(page_id.alias("page_id"), F.concat(F.lit("wiki/syntheses/"), "slug", F.lit(".md")).alias("target_path"), F.concat(F.lit("synthesis:"), "answer_id").alias("source_id"), "title", links.alias("links"), body.alias("content"))
