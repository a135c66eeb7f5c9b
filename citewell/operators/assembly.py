"""Results put together for a caller, and checks of what callers hand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a plan may hold, and how much of a catalog a planner sees.
SUBQUERIES, QUERY_LENGTH, CONFIDENCES = 8, 240, ("cited", "weak", "uncited")
OVERVIEW = {"source": 80, "page": 120, "alias": 160}
SECTIONS = {"source": ("Claims",), "concept": ("Definition",), "entity": ("Definition",)}
RUN_READY = ("staged", "reviewed")


def contexts(questions: DataFrame, candidates: DataFrame, selected: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """query_id, n, contexts (by rank), warnings, failure_stage of every question.

    no_terms: nothing to search by; candidate_miss: no candidate; ranking_miss: candidates, but none selected.
    """
    item = F.struct("rank", "claim_id", "source_id", "page_id", "claim_text", "citation_locator", "confidence_status", "selection_reason")
    found = selected.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("contexts"), F.max(F.when(F.col("confidence_status") != "cited", 1).otherwise(0)).alias("weak"))
    pool = candidates.groupBy("query_id").agg(F.count("*").alias("pool"))
    rows = questions.select("query_id", F.size("text_terms").alias("terms")).join(pool, "query_id", "left").join(found, "query_id", "left")
    if contradictions is not None:
        rows = rows.join(contradictions.select("query_id").distinct().withColumn("against", F.lit(1)), "query_id", "left")
    else:
        rows = rows.withColumn("against", F.lit(None).cast("int"))
    n = F.when(F.col("contexts").isNull(), 0).otherwise(F.size("contexts"))
    stage = F.when(F.col("terms") == 0, "no_terms").when(F.coalesce("pool", F.lit(0)) == 0, "candidate_miss").when(n == 0, "ranking_miss")
    warnings = F.array_compact(F.array(F.when(n == 0, "no evidence found"), F.when(F.col("weak") == 1, "weak evidence"), F.when(F.col("against") == 1, "contradicting evidence")))
    return rows.select("query_id", n.cast("long").alias("n"), "contexts", warnings.alias("warnings"), stage.alias("failure_stage"))


def prompt_text(assembled: DataFrame) -> DataFrame:
    """query_id, prompt: the contexts of a question as numbered lines."""
    line = lambda x: F.concat(F.lit("["), x["rank"], F.lit("] "), T.squeeze(x["claim_text"]), F.lit(" ("), x["source_id"], F.lit(", "), x["citation_locator"], F.lit(", "), x["confidence_status"], F.lit(")"))
    return assembled.select("query_id", F.coalesce(F.array_join(F.transform("contexts", line), "\n"), F.lit("")).alias("prompt"))


def overview(catalog) -> DataFrame:
    """kind, place, name, detail: the first sources by title, pages by type and title, aliases by name, as a planner sees them."""
    order = F.array_position(F.array(*[F.lit(p) for p in T.PAGE_ORDER]), F.col("detail"))
    parts = {
        "source": (catalog.sources.select(F.col("title").alias("name"), F.col("source_id").alias("detail")), ["name", "detail"]),
        "page": (catalog.pages.select(F.col("title").alias("name"), F.col("page_type").alias("detail")), [order, "name"]),
        "alias": (catalog.aliases.select(F.col("alias").alias("name"), F.col("target_id").alias("detail")), ["name", "detail"]),
    }
    out = None
    for kind, (rows, by) in parts.items():
        top = rows.orderBy(*by).limit(OVERVIEW[kind])  # a hundred rows at most; the window numbers those alone
        part = top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*by)).alias("place"), "name", "detail")
        out = part if out is None else out.unionByName(part)
    return out


def plan_problems(subqueries: DataFrame, sources: DataFrame) -> DataFrame:
    """plan_id, place, problem of subqueries (plan_id, place, query, source_id, confidence): the first that applies."""
    count = F.count("*").over(Window.partitionBy("plan_id"))
    rows = subqueries.withColumn("count", count).join(sources.select("source_id", F.lit(True).alias("known")), "source_id", "left")
    problem = (
        F.when(F.col("count") > SUBQUERIES, "too_many_subqueries").when(T.strip(F.coalesce("query", F.lit(""))) == "", "empty_query").when(F.length("query") > QUERY_LENGTH, "long_query")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").isin(*CONFIDENCES), "unknown_confidence").when(F.col("source_id").isNotNull() & F.col("known").isNull(), "unknown_source")
    )
    return rows.select("plan_id", "place", problem.alias("problem")).filter(F.col("problem").isNotNull())


def front_matter(content) -> F.Column:
    """key -> value of the lines between the first two --- lines."""
    inner = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1)
    return F.str_to_map(inner, F.lit("\n"), F.lit(": "))


def patch_problems(patches: DataFrame) -> DataFrame:
    """page_id, problem of page patches (page_id, page_type, target_path, content): the first that applies."""
    missing = F.lit(False)
    for kind, names in SECTIONS.items():
        for name in names:
            missing = missing | ((F.col("page_type") == kind) & ~F.col("content").rlike(rf"(?m)^##\s+{name}\s*$"))
    problem = (
        F.when(~F.col("page_type").isin(*T.PAGE_ORDER), "unknown_page_type").when(~F.col("target_path").startswith("wiki/") | F.contains("target_path", F.lit("..")) | ~F.col("target_path").endswith(".md"), "unsafe_path")
        .when(~F.coalesce(F.map_contains_key(front_matter(F.col("content")), "page_id"), F.lit(False)), "no_front_matter").when(missing, "missing_section")
    )
    return patches.select("page_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def section_items(pages: DataFrame) -> DataFrame:
    """page_id, section, items: bullets under each second-level heading of pages (page_id, content)."""
    lines = pages.select("page_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    head = F.when(F.col("text").rlike(r"^##\s+\S"), T.strip(F.regexp_replace("text", r"^##\s+", "")))
    so_far = Window.partitionBy("page_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(head, True).over(so_far)).filter(F.col("section").isNotNull())
    return rows.groupBy("page_id", "section").agg(F.sum(F.when(F.col("text").rlike(r"^[-*]\s+\S"), 1).otherwise(0)).alias("items"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """source_id, run_id of the run of each source that was applied last; of equal times the later created, then the larger id."""
    return runs.filter(F.col("status") == "applied").groupBy("source_id").agg(F.max_by("run_id", F.struct("applied_at", "created_at", "run_id")).alias("run_id"))


def run_problems(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, problem of the asked runs (run_id) that may not be applied: not in runs(run_id, status), or applied or failed already.

    A run without a status is staged.
    """
    rows = asked.select("run_id").join(runs.select("run_id", F.coalesce("status", F.lit(RUN_READY[0])).alias("status")), "run_id", "left")
    problem = F.when(F.col("status").isNull(), "no_manifest").when(~F.col("status").isin(*RUN_READY), F.concat(F.lit("status_"), "status"))
    return rows.select("run_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def relationship_types(relationships: DataFrame) -> DataFrame:
    """The distinct relationship_type of a catalog, as a planner sees them."""
    return relationships.select("relationship_type").distinct().orderBy("relationship_type")


def index_problems(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """problem, n of a vector index: chunks without a vector, vectors without a chunk, of another length, or not finite."""
    both = chunks.select("chunk_id", F.lit(1).alias("c")).join(vectors.select("chunk_id", "vector"), "chunk_id", "full_outer")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.col("vector").isNull(), "no_vector").when(F.col("c").isNull(), "no_chunk").when(F.size("vector") != dimension, "wrong_dimension").when(odd, "not_finite")
    return both.select(problem.alias("problem")).filter(F.col("problem").isNotNull()).groupBy("problem").agg(F.count("*").alias("n"))


def index_status(manifest: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """index_present, stale, chunk_count, failure_stage of a manifest (catalog_fingerprint, chunk_count; at most one row) against today's fingerprint."""
    row = fingerprint.select(F.lit(1).alias("_k"), F.col("fingerprint").alias("now")).join(manifest.select(F.lit(1).alias("_k"), "catalog_fingerprint", "chunk_count"), "_k", "left")
    present = F.col("catalog_fingerprint").isNotNull()
    stage = F.when(~present, "missing_index")
    return row.select(present.alias("index_present"), (~F.coalesce(F.col("catalog_fingerprint") == F.col("now"), F.lit(False))).alias("stale"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), stage.alias("failure_stage"))


def failure_stages(expected: DataFrame, pool: DataFrame, selected: DataFrame) -> DataFrame:
    """case_id, stage: where a case (case_id, source_id expected) lost its sources: found, ranking_miss or candidate_miss."""
    flag = lambda df, name: df.select("case_id", "source_id", F.lit(1).alias(name)).distinct()
    rows = expected.select("case_id", "source_id").distinct().join(flag(pool, "pooled"), ["case_id", "source_id"], "left").join(flag(selected, "picked"), ["case_id", "source_id"], "left")
    per = rows.groupBy("case_id").agg(F.max("pooled").alias("pooled"), F.max("picked").alias("picked"))
    return per.select("case_id", F.when(F.col("picked") == 1, "found").when(F.col("pooled") == 1, "ranking_miss").otherwise("candidate_miss").alias("stage"))
