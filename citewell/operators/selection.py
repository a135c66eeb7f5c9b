"""Reranking and evidence selection as windows over candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Relationship labels by priority.
PRIORITY = ("contradicts", "supports", "refines", "contains", "similar_to")
#: Problems of an index that go without a warning.
QUIET = ("index is missing", "disabled")


def reranked(pool: DataFrame, name: str = "rerank_score") -> DataFrame:
    """Candidates (query_id, claim_id, raw_score, retriever_rank, confidence_status, ...) with score, duplicate index and rank."""
    same = Window.partitionBy("query_id", T.duplicate_key(F.col("claim_text"))).orderBy(F.desc("raw_score"), "retriever_rank", "claim_id")
    rows = pool.withColumn("duplicate_index", F.row_number().over(same) - 1)
    status = F.when(F.col("confidence_status") == "cited", 0.18).when(F.col("confidence_status").isin("weak", "uncited"), -0.18).otherwise(0.0)
    locator = F.when(F.coalesce("citation_locator", F.lit("")) != "", 0.04).otherwise(0.0)
    semantic = F.when(F.array_contains("retrievers", "vector"), 0.03).otherwise(0.0) if "retrievers" in pool.columns else F.lit(0.0)
    score = F.lit(0.65) * F.least(F.greatest(F.col("raw_score"), F.lit(0.0)), F.lit(1.0)) + F.lit(0.2) / (F.col("retriever_rank") + 1) + status + locator + semantic
    score = F.greatest(score, F.lit(0.0)) * F.when(F.col("duplicate_index") > 0, 0.7).otherwise(1.0)
    rows = rows.withColumn(name, F.round(score, 6))
    return rows.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(name), "retriever_rank", "claim_id")))


def embedding_reranked(rows: DataFrame, similarities: DataFrame) -> DataFrame:
    """Reranked rows mixed with similarities (query_id, claim_id, similarity); a missing one is 0.  Halves of the last digit go up."""
    joined = rows.join(similarities, ["query_id", "claim_id"], "left")
    most = F.max("rerank_score").over(Window.partitionBy("query_id"))
    share = F.when(most > 0, F.col("rerank_score") / most).otherwise(0.0)
    mixed = joined.withColumn("rerank_score", F.round(F.lit(0.65) * F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))) + F.lit(0.35) * share + 1e-9, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retriever_rank", "claim_id")
    return mixed.withColumn("candidate_rank", F.row_number().over(order)).drop("similarity")


def provided_reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Reranked by scores (query_id, claim_id, score) from outside; candidates without one get 0."""
    joined = rows.join(scores, ["query_id", "claim_id"], "left").withColumn("rerank_score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retriever_rank", "claim_id")
    return joined.withColumn("candidate_rank", F.row_number().over(order)).drop("score")


def dispatched(pool: DataFrame, method: str = "deterministic", similarities: DataFrame | None = None, scores: DataFrame | None = None, problem: str = "index is missing") -> DataFrame:
    """Reranked by "embedding" similarities or "provided" scores, with method and warning; what is not given falls back to the deterministic order.

    ``problem`` says why there are no similarities; a missing or disabled index is no warning.
    """
    rows, used, warning = reranked(pool), "deterministic", None
    if method == "embedding":
        if similarities is not None:
            rows, used = embedding_reranked(rows, similarities), method
        elif not any(quiet in problem.lower() for quiet in QUIET):
            warning = problem
    elif method == "provided":
        if scores is not None:
            rows, used = provided_reranked(rows, scores), method
        else:
            warning = "no scores were provided"
    return rows.withColumns({"requested": F.lit(method), "method": F.lit(used), "warning": F.lit(warning).cast("string")})


def relationship_order(found: DataFrame) -> DataFrame:
    """Each question's relationships once, with their place by type, subject, object and evidence."""
    order = ["relationship_type", "subject_id", "object_id", "evidence_claim_id"]
    return found.select("query_id", *order).distinct().withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def coverage_group() -> Column:
    """The page, unless it is a source's own."""
    page = F.coalesce("page_id", F.lit(""))
    return F.when((page != "") & ~page.startswith("src_"), page).otherwise(F.concat(F.lit("source:"), "source_id"))


def mode(terms: Column, contradicts: Column, forced: Column, source_filter: Column) -> Column:
    """The first that applies: forced, conflict, one source, one catalog term, several, none."""
    known = F.when(forced.isin("broad", "focused", "comparison", "conflict"), forced).when(forced.isNotNull(), "broad")
    return F.when(forced.isNotNull(), known).when(contradicts, "conflict").when(source_filter.isNotNull(), "focused").when(F.size(terms) == 1, "focused").when(F.size(terms) >= 2, "comparison").otherwise("broad")


def select_evidence(rows: DataFrame, limit: int, per_source: int = 3, focus_least: int = 3) -> DataFrame:
    """Reranked rows with ``mode`` and ``contradiction`` (evidence of a contradicts relationship) cut to the selected ones.

    A row is picked in its earliest stage, by stage, then rank.  Forced rows always pass and count for their source;
    of the others the first per source up to the cap pass, so the cap is a rank.  The limit comes last.
    """
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("coverage_group", coverage_group()).withColumn("redundancy_group", T.duplicate_key(F.col("claim_text")))
    # one row of each claim, then of each text
    once = rows.withColumn("_c", F.row_number().over(Window.partitionBy("query_id", "claim_id").orderBy("candidate_rank"))).filter(F.col("_c") == 1)
    once = once.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "redundancy_group").orderBy("candidate_rank"))).filter(F.col("_r") == 1)
    once = once.withColumn("order_rank", F.row_number().over(q.orderBy("candidate_rank")))
    cited = F.col("confidence_status") == "cited"
    group = Window.partitionBy("query_id", "coverage_group")
    once = once.withColumn("group_rank", F.row_number().over(group.orderBy(F.when(cited, 0).otherwise(1), F.desc("rerank_score"), "claim_id"))).withColumn("group_first", F.min("order_rank").over(group))
    once = once.withColumn("dominant", F.first("coverage_group").over(q.orderBy("order_rank")))
    home = F.col("coverage_group") == F.col("dominant")
    once = once.withColumn("home", home).withColumn("home_cited", F.sum(F.when(home & cited, 1).otherwise(0)).over(q))
    focused, conflict = F.col("mode") == "focused", F.col("mode") == "conflict"
    enough = F.col("home_cited") >= F.least(F.lit(limit), F.lit(focus_least))
    stage = (
        F.when(focused & home & ((F.col("home_cited") == 0) | cited), 0).when(focused & ~home & ~enough, 1).when(focused, F.lit(None))
        .when(conflict & (F.col("order_rank") == 1), 0).when(conflict & F.col("contradiction"), 1).when(F.col("group_rank") == 1, 2).otherwise(3)
    )
    forced = F.when(focused, F.col("home") & enough).otherwise(conflict & (F.col("stage") <= 1))
    staged = once.withColumn("stage", stage.cast("int")).filter(F.col("stage").isNotNull()).withColumn("forced", forced)
    key = F.when(F.col("stage") == 2, F.col("group_first")).otherwise(F.col("order_rank"))
    staged = staged.withColumn("pick", F.row_number().over(q.orderBy("stage", key, "order_rank")))
    staged = staged.withColumn("of_source", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy("pick")))
    passed = staged.filter(F.col("forced") | (F.col("of_source") <= per_source)).withColumn("rank", F.row_number().over(q.orderBy("pick")))
    reason = F.when(focused & (F.col("stage") == 0), "focused_dominant_group").when(focused, "fill_after_focused_evidence_exhausted").when(conflict & (F.col("stage") == 0), "top_ranked").when(F.col("stage") == 1, "conflict_evidence").when((F.col("stage") == 2) & (F.col("confidence_status") == "cited"), "best_cited_for_coverage").when(F.col("stage") == 2, "best_for_coverage").otherwise("score_fill")
    return passed.filter(F.col("rank") <= limit).withColumn("selection_reason", reason).drop("_c", "_r", "group_rank", "group_first", "home_cited", "of_source", "pick", "order_rank")


def diagnostics(selected: DataFrame) -> DataFrame:
    """query_id, n, source_diversity, coverage_groups, outside_dominant of the selected rows."""
    return selected.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("source_diversity"), F.countDistinct("coverage_group").alias("coverage_groups"), F.sum(F.when(F.col("home"), 0).otherwise(1)).alias("outside_dominant"))


def related(candidates: DataFrame, relationships: DataFrame) -> DataFrame:
    """query_id, claim_id and every relationship that rests on the claim or belongs to its source, once: two equi-joins."""
    r = relationships.withColumnRenamed("source_id", "r_source")
    c = candidates.select("query_id", "claim_id", "source_id").distinct()
    by_claim = c.join(r, F.col("claim_id") == F.col("evidence_claim_id"))
    by_source = c.join(r, F.col("source_id") == F.col("r_source"))
    return by_claim.unionByName(by_source).distinct()


def relationship_label(candidates: DataFrame, relationships: DataFrame) -> DataFrame:
    """query_id, claim_id, label: the first by priority of the claim's own rows, else of its source's, else supports."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("relationship_type"))
    own = F.when(F.col("claim_id") == F.col("evidence_claim_id"), 0).otherwise(1)
    best = related(candidates, relationships).groupBy("query_id", "claim_id").agg(F.min_by("relationship_type", F.struct(own.alias("o"), place.alias("p"))).alias("label"))
    return candidates.select("query_id", "claim_id").distinct().join(best, ["query_id", "claim_id"], "left").select("query_id", "claim_id", F.coalesce("label", F.lit("supports")).alias("label"))


def merge_planned(contexts: DataFrame, limit: int, most: int = 32) -> DataFrame:
    """Contexts (plan_id, subquery, subqueries, rank, claim_id, score, query) of a plan's subqueries in turn, each claim once.

    Round robin is order by rank, then subquery; a claim keeps its first row, all its queries and its best score.  Its
    lineage is in that order: queries and indexes, purposes (blank ones left out) and reasons, the last two only if the
    contexts have ``purpose`` and ``reasons`` (array).
    """
    first = F.struct("rank", "subquery")
    more = [c for c in ("purpose", "reasons") if c in contexts.columns]
    grouped = contexts.groupBy("plan_id", "claim_id").agg(
        F.min(first).alias("first"), F.max("score").alias("score"), F.max("subqueries").alias("subqueries"),
        F.array_sort(F.collect_list(F.struct("rank", "subquery", "query", *more))).alias("steps"),
    )
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("first.rank", "first.subquery", "claim_id"))
    budget = F.least(F.greatest(F.lit(limit), F.lit(limit) * F.col("subqueries")), F.lit(most))
    each = lambda c: F.transform("steps", lambda x: x[c])
    lineage = [F.array_distinct(each("query")).alias("queries"), F.array_distinct(each("subquery")).alias("indexes")]
    if "purpose" in more:
        lineage.append(F.array_distinct(F.filter(each("purpose"), lambda x: x != "")).alias("purposes"))
    if "reasons" in more:
        lineage.append(F.array_distinct(F.flatten(each("reasons"))).alias("reasons"))
    kept = grouped.withColumn("merged_rank", place).filter(F.col("merged_rank") <= budget)
    return kept.select("plan_id", "merged_rank", "claim_id", F.col("first.subquery").alias("subquery_index"), "score", *lineage)


def citation_problems(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """answer_id, claim_id, problem of citations (answer_id, claim_id, source_id, locator) that their contexts don't bear out."""
    known = contexts.select("answer_id", "claim_id", F.col("source_id").alias("known_source"), F.col("citation_locator").alias("known_locator"))
    rows = citations.join(known, ["answer_id", "claim_id"], "left")
    problem = F.when(F.col("known_source").isNull(), "unknown_claim").when(F.col("source_id") != F.col("known_source"), "wrong_source").when(~F.col("locator").eqNullSafe(F.col("known_locator")), "wrong_locator")
    return rows.select("answer_id", "claim_id", problem.alias("problem")).filter(F.col("problem").isNotNull())
