"""A batch of questions with filters of their own finds what each of them finds alone."""

import pytest

from citewell.operators import index, retrieval, selection
from tests.test_knowledge import small

FILTERS = {1: {"confidence": "cited"}, 2: {"source_id": "src_3"}, 3: {"page_type": "concept"}, 4: {"page_type": "source", "source_id": "src_1", "confidence": "weak"}, 5: {}}


@pytest.fixture(scope="module")
def catalog(spark):
    from pyspark.sql import functions as F

    c = small(spark)
    c.claims = c.claims.withColumn("confidence_status", F.when(F.substring("claim_id", -1, 1).isin("0", "4", "7"), "weak").otherwise("cited"))
    return c


def wanted(spark):
    rows = [(q, f.get("source_id", ""), f.get("page_type"), f.get("confidence")) for q, f in FILTERS.items()]
    return {"each": retrieval.filters_of(spark.createDataFrame(rows, "query_id int, source_id string, page_type string, confidence string"))}


@pytest.mark.parametrize(("name", "alone"), [("graph", (2, 4)), ("vector", (1, 4)), ("alias", (3, 4)), ("span", (4,))])
def test_own_filters_in_every_retriever(spark, catalog, name, alone, limit=4):
    asked = spark.createDataFrame([(q, t := [f"word{q % 5}", "concept", "concept0"], t) for q in FILTERS], "query_id int, text_terms array<string>, exact_spans array<string>")
    seeds = spark.createDataFrame([(q, f"c{q:03d}", f"src_{q}", "concept:0") for q in FILTERS], "query_id int, claim_id string, source_id string, page_id string")
    hits = spark.createDataFrame([(q, chunk, s) for q in FILTERS for chunk, s in (("claim:c007", 0.5), ("source_title:src_3", 0.9), ("page_title:concept:1", 0.8))], "query_id int, chunk_id string, score double")
    built = index.build_index(catalog.claims)
    of = lambda rows, q: rows if q is None else rows.filter(f"query_id = {q}")
    retrievers = {
        "alias": lambda f, q: retrieval.alias_title(of(asked, q), catalog, limit, f, built),
        "span": lambda f, q: retrieval.exact_span(of(asked, q), catalog, limit, f, built),
        "graph": lambda f, q: retrieval.graph(of(seeds, q), catalog, limit, 3, f),
        "vector": lambda f, q: retrieval.vector_candidates(of(hits, q), catalog, limit, f),
    }
    run = retrievers[name]
    batch = run(wanted(spark), None).collect()
    for q in alone:
        assert sorted(map(repr, (r for r in batch if r.query_id == q))) == sorted(map(repr, run(FILTERS[q], q).collect())), q


def test_lineage_follows_the_round_robin(spark):
    rows = [("p", 2, 2, 1, "b", 0.5, "two", "", ["r"]), ("p", 1, 2, 1, "a", 0.4, "one", "why", ["x", "y"]), ("p", 2, 2, 2, "a", 0.9, "two", "", ["y", "z"]), ("p", 1, 2, 2, "c", 0.1, "one", "why", [])]
    contexts = spark.createDataFrame(rows, "plan_id string, subquery int, subqueries int, rank int, claim_id string, score double, query string, purpose string, reasons array<string>")
    got = selection.merge_planned(contexts, 8).orderBy("merged_rank").collect()
    assert [(r.claim_id, r.score, r.subquery_index, r.queries, r.indexes, r.purposes, r.reasons) for r in got] == [
        ("a", 0.9, 1, ["one", "two"], [1, 2], ["why"], ["x", "y", "z"]), ("b", 0.5, 2, ["two"], [2], [], ["r"]), ("c", 0.1, 1, ["one"], [1], ["why"], []),
    ]


def test_each_stage_of_a_vector_search(spark):
    states = [("off", False, True, None, 2), ("gone", True, False, "x", 2), ("broken", True, True, "unreadable", 2), ("good", True, True, None, 2), ("bare", None, None, None, None)]
    indexes = spark.createDataFrame(states, "index_id string, enabled boolean, present boolean, error string, dimension int")
    vector = [1.0, 0.0]
    rows = [
        (1, "off", None, "e", "disabled", None), (2, "unknown", vector, None, "missing_index", None), (3, "bare", vector, None, "disabled", None), (4, None, vector, None, "missing_index", None), (5, "gone", vector, "e", "missing_index", None),
        (6, "broken", vector, "e", "index_load_failed", "unreadable"), (7, "good", None, "e", "query_embedding_failed", "e"), (8, "good", None, None, "empty_query_vector", None), (9, "good", [], None, "empty_query_vector", None),
        (10, "good", [1.0], None, "query_dimension_mismatch", "dimensions of query and index differ"), (11, "good", vector, None, None, None),
    ]
    queries = spark.createDataFrame([r[:4] for r in rows], "query_id int, index_id string, query_vector array<double>, error string")
    got = retrieval.vector_stages(queries, indexes).orderBy("query_id").collect()
    assert [(r.query_id, r.failure_stage, r.warning) for r in got] == [(r[0], *r[4:]) for r in rows]


@pytest.mark.parametrize("name", ["alias_title", "exact_span"])
def test_one_pass_finds_what_the_index_finds(spark, catalog, name, limit=4):
    asked = spark.createDataFrame([(q, t := [f"word{q % 5}", "concept", "concept0"], t) for q in FILTERS], "query_id int, text_terms array<string>, exact_spans array<string>")
    got, want = (sorted(map(repr, getattr(retrieval, name)(asked, catalog, limit, wanted(spark), x).collect())) for x in (None, index.build_index(catalog.claims)))
    assert got == want and got


def test_one_pass_hands_on_the_best_of_each_task(spark):
    from citewell.operators import matching
    from citewell.operators.asked import tokens

    claims = spark.range(3000).selectExpr("concat('c', lpad(id, 5, '0')) AS claim_id", "concat_ws(' ', 'all', 'w' || id % 7, 'v' || id % 3, 'all') AS claim_text").repartition(3)
    asked = spark.createDataFrame([(q, p, 1) for q in range(40) for p in ("all", f"w{q % 7}", f"w{q % 7} v{q % 3}")], "query_id int, phrase string, times int")
    best = matching.full_text(asked, claims, tokens(claims.claim_text), 5, index.weight)
    rows = [r["count"] for r in best.groupBy("query_id").count().collect()]
    assert len(rows) == 40 and max(rows) <= 3 * 5  # not a row for each of the 3000 claims that hold a phrase
