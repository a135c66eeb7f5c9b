"""Retrieval metrics over result rows and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import keep

#: Fixed value: the depth of precision, nDCG and MAP.
DEPTH = 5


def case_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case hit, recall, precision, mrr, ndcg, map of results (case_id, rank, source_id) against expected (case_id, source_id)."""
    want = expected.select("case_id", "source_id").distinct()
    rows = results.join(want.withColumn("hit", F.lit(1)), ["case_id", "source_id"], "left").select("case_id", "rank", F.coalesce("hit", F.lit(0)).alias("rel"), F.when(F.col("hit") == 1, F.col("source_id")).alias("found"))
    matched = rows.groupBy("case_id").agg(F.countDistinct("found").alias("matched"))
    return _metrics(rows, want.groupBy("case_id").agg(F.count("*").alias("expected")).join(matched, "case_id", "left"))


def _metrics(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of judged rows (case_id, rank, rel) for cases (case_id, expected, matched)."""
    rows = rows.withColumn("so_far", F.sum("rel").over(Window.partitionBy("case_id").orderBy("rank")))
    inside = F.col("rank") <= DEPTH
    gain = F.when(inside & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    step = F.when(inside & (F.col("rel") == 1), F.col("so_far") / F.col("rank")).otherwise(0.0)
    per = rows.groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum("rel").alias("relevant"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.sum(step).alias("steps"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(DEPTH), F.col("expected")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = cases.join(per, "case_id", "left")
    return joined.select(
        "case_id",
        F.when(F.coalesce("relevant", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.least(F.lit(1.0), F.coalesce("matched", F.lit(0)) / F.col("expected")), 4).alias("recall"),
        F.round(zero(F.col("relevant") / F.least(F.lit(DEPTH), F.col("n"))), 4).alias("precision"),
        F.round(zero(1 / F.col("first")), 4).alias("mrr"),
        F.round(zero(F.col("dcg") / ideal), 4).alias("ndcg"),
        F.round(zero(F.col("steps") / F.least(F.lit(DEPTH), F.col("expected"))), 4).alias("map"),
    )


def _met(contexts: DataFrame, want: DataFrame) -> DataFrame:
    """case_id, rank, kind, value: which expectations each context meets, by key, or by a term in its text or path."""
    keys = [F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in (("claim", "claim_id"), ("source", "source_id"), ("page", "page_id"))]
    named = contexts.select("case_id", "rank", F.explode(F.array(*keys)).alias("k")).select("case_id", "rank", "k.kind", "k.value").join(want, ["case_id", "kind", "value"])
    text = contexts.select("case_id", "rank", F.lower(F.concat_ws(" ", "claim_text", "page_path")).alias("text"))
    terms = text.join(want.filter(F.col("kind") == "term"), "case_id").filter(F.contains("text", F.lower("value")))
    columns = ["case_id", "rank", "kind", "value"]
    return named.select(columns).unionByName(terms.select(columns)).distinct()


def expectation_metrics(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """case_metrics and coverage where cases expect claims, sources, pages and terms: expected (case_id, kind, value).

    contexts(case_id, rank, claim_id, source_id, page_id, page_path, claim_text).  A context is relevant that meets any
    expectation; recall counts expectations met.  Coverage is the share met of the expected sources, where there are
    none of the pages, then of the claims, else whether there is any context.
    """
    want = expected.select("case_id", "kind", "value").distinct()
    met = _met(contexts, want)
    of_kind = [F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)) for kind in ("source", "page", "claim")]
    cases = want.groupBy("case_id").agg(F.count("*").alias("expected"), F.array(*of_kind).alias("kinds"))
    found = met.select("case_id", "kind", "value").distinct().groupBy("case_id").agg(F.count("*").alias("matched"), F.array(*of_kind).alias("met"))
    cases = cases.join(found, "case_id", "left")
    rows = contexts.select("case_id", "rank").join(met.select("case_id", "rank", F.lit(1).alias("hit")).distinct(), ["case_id", "rank"], "left").select("case_id", "rank", F.coalesce("hit", F.lit(0)).alias("rel"))
    share = None
    for i in range(3):
        here = F.col("kinds")[i] > 0
        part = F.round(F.coalesce(F.col("met")[i], F.lit(0)) / F.col("kinds")[i], 4)
        share = F.when(here, part) if share is None else share.when(here, part)
    some = contexts.select("case_id", F.lit(1.0).alias("some")).distinct()
    covered = cases.join(some, "case_id", "left").select("case_id", share.otherwise(F.coalesce("some", F.lit(0.0))).alias("coverage"))
    return _metrics(rows, cases).join(covered, "case_id")


def exposures(cases: DataFrame, contexts: DataFrame, relationships: DataFrame, warnings: DataFrame) -> DataFrame:
    """case_id, conflict_exposure, weak_visibility, missing_relationship of cases (case_id, required array of relationship types).

    A contradiction may also be shown by a warning (case_id, warning) that speaks of it; weak evidence has to be.
    """
    shown = relationships.groupBy("case_id").agg(F.collect_set("relationship_type").alias("types"))
    weak = contexts.groupBy("case_id").agg(F.max(F.col("confidence_status").isin("weak", "uncited").cast("int")).alias("weak"))
    low = F.lower("warning")
    warned = warnings.groupBy("case_id").agg(F.max(F.contains(low, F.lit("contradict")).cast("int")).alias("of_conflict"), F.max(F.contains(low, F.lit("weak/uncited")).cast("int")).alias("of_weak"))
    rows = cases.join(shown, "case_id", "left").join(weak, "case_id", "left").join(warned, "case_id", "left")
    none = F.array().cast("array<string>")
    required = F.coalesce("required", none)
    types = F.array_union(F.coalesce("types", none), F.when(F.col("of_conflict") == 1, F.array(F.lit("contradicts"))).otherwise(none))
    conflict = F.when(~F.array_contains(required, "contradicts") | F.array_contains(types, "contradicts"), 1.0).otherwise(0.0)
    visible = F.when((F.coalesce("weak", F.lit(0)) == 0) | (F.col("of_weak") == 1), 1.0).otherwise(0.0)
    return rows.select("case_id", conflict.alias("conflict_exposure"), visible.alias("weak_visibility"), (F.size(F.array_except(required, types)) > 0).alias("missing_relationship"))


def verdict(evidence: Column, contexts: Column, violations: Column, missing: Column, stage: Column, hit: Column) -> Column:
    """Why a case fails, null if it passes; where no evidence is expected, any context is a failure."""
    return (
        F.when(~evidence & (contexts > 0), "unexpected_evidence").when(~evidence, F.lit(None)).when(violations > 0, "contract_violation").when(missing, "relationship_miss")
        .when(contexts == 0, F.coalesce(stage, F.lit("candidate_miss"))).when(~hit, "ranking_miss")
    )


def relationship_validity(relationships: DataFrame, catalog) -> DataFrame:
    """relationships, relationship_validity: the share whose ends are pages or sources, whose evidence is a claim and whose source exists."""
    nodes = catalog.pages.select(F.col("page_id").alias("node")).unionByName(catalog.sources.select(F.col("source_id").alias("node"))).distinct()
    known = lambda df, old, new: df.select(F.col(old).alias(new), F.lit(True).alias(f"has_{new}")).distinct()
    rows = relationships.join(known(nodes, "node", "subject_id"), "subject_id", "left").join(known(nodes, "node", "object_id"), "object_id", "left")
    rows = rows.join(known(catalog.claims, "claim_id", "evidence_claim_id"), "evidence_claim_id", "left").join(known(catalog.sources, "source_id", "source_id"), "source_id", "left")
    source = F.col("has_source_id").isNotNull() | F.col("source_id").startswith("synthesis:")
    valid = F.col("has_subject_id").isNotNull() & F.col("has_object_id").isNotNull() & F.col("has_evidence_claim_id").isNotNull() & F.coalesce(source, F.lit(False))
    return rows.agg(F.count("*").alias("relationships"), F.coalesce(F.round(F.avg(F.when(valid, 1.0).otherwise(0.0)), 4), F.lit(1.0)).alias("relationship_validity"))


def two_decimals(value: Column) -> Column:
    """The number with two decimals: its exact binary value is rounded, halves to even (0.125 is 0.12, 0.285 is 0.28)."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def report_lines(cases: DataFrame) -> DataFrame:
    """case_id, line: one line of a report for each case, pass or fail and its metrics."""
    metrics = ("hit", "recall", "precision", "mrr", "ndcg", "map")
    state = F.when(F.col("hit") > 0, "pass").otherwise("fail")
    return cases.select("case_id", F.concat_ws(" ", state, *[F.concat(F.lit(f"{c}="), two_decimals(F.col(c))) for c in metrics]).alias("line"))


def summary(cases: DataFrame) -> DataFrame:
    """Cases, passes and the mean of each metric, 0 where there are none."""
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in ("hit", "recall", "precision", "mrr", "ndcg", "map")]
    return cases.agg(F.count("*").alias("cases"), F.coalesce(F.sum(F.when(F.col("hit") > 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("passed"), *means)


def percentiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles by key: the value at place round((n - 1) p), halves to even.

    Equal values are counted first.  They are then spread over ranges of (key, value), so no key has to fit a task:
    sums by range tell which range holds a place, and only within it are values numbered.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    ranges = keep(counted.repartitionByRange(key, value).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(key, "range").agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy(key)
    before = F.sum("n").over(by_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    places = sums.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("n").over(by_key))
    targets = F.array(*[F.bround((F.col("total") - 1) * F.lit(p)).cast("long") for p in shares])
    places = places.select(key, "range", "before", "n", F.posexplode(targets).alias("share", "place")).filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    so_far = F.sum("n").over(Window.partitionBy(key, "range").orderBy(value))
    held = ranges.join(places.select(key, "range").distinct(), [key, "range"], "left_semi").withColumn("upto", so_far)
    found = held.join(places.drop("n"), [key, "range"]).filter(F.col("before") + F.col("upto") > F.col("place"))
    return found.groupBy(key).agg(*[F.min(F.when(F.col("share") == i, F.col(value))).alias(f"p{round(100 * p)}") for i, p in enumerate(shares)])


def contract(contexts: DataFrame, catalog) -> DataFrame:
    """Share of contexts whose claim, source, page and locator hold, 1 where there are none."""
    claims = catalog.claims.select("claim_id", F.lit(True).alias("has_claim"))
    sources = catalog.sources.select("source_id", F.lit(True).alias("has_source"))
    pages = catalog.pages.select("page_id", F.lit(True).alias("has_page"))
    written = F.coalesce(F.col("source_id").startswith("synthesis:"), F.lit(False))
    rows = contexts.join(claims, "claim_id", "left").join(sources, "source_id", "left").join(pages, "page_id", "left")
    share = lambda flag, name: F.coalesce(F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 4), F.lit(1.0)).alias(name)
    return rows.agg(F.count("*").alias("contexts"), share(F.col("has_claim"), "claim_validity"), share(F.col("has_source") | written, "source_validity"), share(F.col("has_page"), "page_validity"), share(F.coalesce("citation_locator", F.lit("")) != "", "locator_presence"))


def diversity(results: DataFrame) -> DataFrame:
    """Per case source diversity and redundancy of its texts (case_id, source_id, claim_text)."""
    from ..functions.text import duplicate_key

    return results.groupBy("case_id").agg(
        F.round(F.countDistinct("source_id") / F.count("*"), 4).alias("source_diversity"), F.round(1 - F.countDistinct(duplicate_key(F.col("claim_text"))) / F.count("*"), 4).alias("redundancy")
    )
