"""Runs that are applied, cases that are judged, answers that are kept, and retrieval in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from citewell.operators import answers, applying, assembly, evaluation, retrieval
from citewell.plans import catalog as C
from citewell.plans import store

CLAIMS = "claim_id string, source_id string, claim_text string, citation_locator string, confidence_status string, created_at string"


def small(spark):
    claims = [(f"c{i:03d}", f"src_{i % 7}", f"word{i % 5} and term{i % 3}", f"line:{i}", "cited", "t") for i in range(60)]
    sources = [(f"src_{i}", f"Title word{i}", f"concept:{i % 2}") for i in range(7)]
    pages = [(s, f"wiki/sources/{s}.md", "source", t) for s, t, _ in sources] + [(f"concept:{i}", f"wiki/concepts/{i}.md", "concept", f"Concept {i}") for i in range(2)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return C.Catalog(
        frame(sources, "source_id string, title string, concept_id string"), frame(claims, CLAIMS),
        frame([("Concept 0", "concept", "concept:0", "concept0")], "alias string, target_type string, target_id string, normalized_alias string"),
        frame([(*p, "[]", "t") for p in pages], "page_id string, path string, page_type string, title string, aliases string, updated_at string"),
        frame([(s, c, "mentions") for s, _, c in sources], "from_page string, to_page string, link_type string"),
        frame([(c, s, "supports", f"c{int(s[4:]):03d}", s) for s, _, c in sources], "subject_id string, object_id string, relationship_type string, evidence_claim_id string, source_id string"),
    )


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_blocks_answer_as_one_batch(spark, monkeypatch):
    c = small(spark)
    asked = spark.createDataFrame([(q, t := [f"word{q % 5}", f"term{q % 3}", "concept0"], t) for q in range(9)], "query_id int, text_terms array<string>, exact_spans array<string>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "chunk_id int, vector array<double>")
    queries = vectors.select((F.col("chunk_id") + 100).alias("query_id"), F.col("vector").alias("query_vector"))
    run = lambda: [plain(x) for x in (retrieval.full_text(asked, c.claims, 20), retrieval.substring(asked, c.claims, 20), retrieval.alias_title(asked, c, 20), retrieval.exact_span(asked, c, 20), retrieval.vector(queries, vectors, 3))]
    whole = run()
    assert all(whole)
    monkeypatch.setattr(store, "BLOCK", 2)
    assert run() == whole


def test_graph_step_through_a_hub(spark):
    c = small(spark)
    seeds = spark.createDataFrame([(1, "c000", "src_0", "concept:0"), (1, "c002", "src_2", "src_2"), (2, "c001", "src_1", "src_1")], "query_id int, claim_id string, source_id string, page_id string")
    got = {}
    for r in retrieval.graph(seeds, c, 5, 3).collect():
        got.setdefault(r.query_id, set()).add(r.claim_id)
    # every source of concept 0 is one step from question 1, its own source only from question 2
    ids = lambda wanted, seen: set([f"c{i:03d}" for i in range(60) if i % 7 in wanted and f"c{i:03d}" not in seen][:5])
    assert got == {1: ids({0, 2, 4, 6}, {"c000", "c002"}), 2: ids({1}, {"c001"})}


def test_titles_lead_to_claims_of_their_sources(spark):
    hits = spark.createDataFrame([(1, "claim:c007", 0.5), (1, "source_title:src_0", 0.9), (1, "claim:gone", 0.9), (2, "page_title:concept:1", 0.5)], "query_id int, chunk_id string, score double")
    rows = retrieval.vector_candidates(hits, small(spark), 100).collect()
    first = {r.claim_id: (r.raw_score, r.reasons) for r in rows if r.query_id == 1}
    assert set(first) == {f"c{i:03d}" for i in range(0, 60, 7)} and first["c007"] == (0.72, ["vector_semantic", "vector_chunk:source_title"])
    assert {r.source_id for r in rows if r.query_id == 2} == {"src_1", "src_3", "src_5"} and {r.raw_score for r in rows if r.query_id == 2} == {0.4}


def test_percentiles_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(40))) for _ in range(3000)] + [("cold", 3.0), ("cold", None), ("none", None)] + [("few", float(i)) for i in range(4)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.p50, r.p95) for r in evaluation.percentiles(frame, "k", "v").collect()}
    for key in ("hot", "cold", "few"):
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == tuple(values[round((len(values) - 1) * p)] for p in (0.5, 0.95))
    assert "none" not in got


def test_apply_run_changes_all_or_nothing(spark):
    c = small(spark)
    patches = spark.createDataFrame([("concept:9", "concept", "Nine", "wiki/concepts/nine.md", ["nine", "IX"])], "page_id string, page_type string, title string, target_path string, aliases array<string>")
    claims = spark.createDataFrame([("c000", "src_0", "other", "line:1", "weak"), ("c999", "src_0", "new", "line:2", "cited")], "claim_id string, source_id string, claim_text string, citation_locator string, confidence_status string")
    links = lambda to: spark.createDataFrame([("wiki/concepts/nine.md", to, "supports")], "from_page string, to_page string, link_type string")
    new = spark.createDataFrame([("concept:9", "src_0", "supports", None, "")], c.relationships.schema)
    after = applying.apply_run(c, claims, patches, links("wiki/sources/src_3.md"), new, "src_0", "now")
    assert {r.claim_text for r in after.claims.filter("claim_id in ('c000', 'c999')").collect()} == {"word0 and term0", "new"}
    assert sorted(r.alias for r in after.aliases.filter("target_id = 'concept:9'").collect()) == ["IX", "Nine"]
    assert after.links.filter("from_page = 'concept:9'").first().to_page == "src_3" and after.pages.count() == 10
    assert tuple(after.relationships.filter("subject_id = 'concept:9'").first()) == ("concept:9", "src_0", "supports", "", "src_0")
    with pytest.raises(ValueError, match="nowhere"):
        applying.apply_run(c, claims, patches, links("nowhere"), new, "src_0", "now")


def test_locators_become_anchors(spark):
    claims = spark.createDataFrame([("a", "s", "see line:3", "weak"), ("b", "s", "line:4", "uncited"), ("c", "s", None, "odd"), ("d", "t", "line:99999999999", "cited")], "claim_id string, source_id string, citation_locator string, confidence_status string")
    anchors = spark.createDataFrame([("s", 3, "line:3;paragraph:1")], "source_id string, line int, locator string")
    got = {r.claim_id: (r.citation_locator, r.confidence_status) for r in applying.canonical_locators(claims, anchors).collect()}
    assert got == {"a": ("line:3;paragraph:1", "cited"), "b": ("", "uncited"), "c": ("", "weak"), "d": ("", "weak")}


def test_runs_keep_their_creation(spark):
    runs = spark.createDataFrame([("r1", "s1", "staged", "t0", None), ("r2", "s2", "staged", "t0", None)], "run_id string, source_id string, status string, created_at string, applied_at string")
    done = spark.createDataFrame([("r1", "other", "t1"), ("r3", "s3", "t1")], "run_id string, source_id string, at string")
    got = sorted(tuple(r) for r in applying.finished_runs(runs, done).collect())
    assert got == [("r1", "s1", "applied", "t0", "t1"), ("r2", "s2", "staged", "t0", None), ("r3", "s3", "applied", "t1", "t1")]


def test_index_of_an_empty_wiki(spark):
    rows = applying.index_lines(small(spark).pages.limit(0)).orderBy("section", F.col("place").asc_nulls_first()).collect()
    assert [r.line for r in rows][:4] == ["## Sources", "No sources applied yet.", "## Concepts", "No concepts applied yet."] and len(rows) == 8


def test_expectations_of_every_kind(spark):
    contexts = spark.createDataFrame([(1, 1, "c1", "s1", "p1", "wiki/p1.md", "Apples keep"), (1, 2, "c2", "s2", "p2", "wiki/p2.md", "Pears")], "case_id int, rank int, claim_id string, source_id string, page_id string, page_path string, claim_text string")
    expected = spark.createDataFrame([(1, "claim", "c2"), (1, "page", "p1"), (1, "page", "p9"), (1, "term", "PEARS"), (2, "term", "x")], "case_id int, kind string, value string")
    one, two = evaluation.expectation_metrics(contexts, expected).orderBy("case_id").collect()
    assert (one.hit, one.recall, one.precision, one.mrr, one.coverage) == (1.0, 0.75, 1.0, 1.0, 0.5)
    assert (two.hit, two.recall, two.mrr, two.coverage) == (0.0, 0.0, 0.0, 0.0)


def test_exposures_and_verdicts(spark):
    cases = spark.createDataFrame([(1, ["contradicts"]), (2, ["contradicts"]), (3, ["refines"]), (4, None)], "case_id int, required array<string>")
    contexts = spark.createDataFrame([(1, "weak"), (2, "cited"), (4, "uncited")], "case_id int, confidence_status string")
    related = spark.createDataFrame([(2, "supports"), (3, "refines")], "case_id int, relationship_type string")
    warnings = spark.createDataFrame([(1, "Weak/uncited; sources contradict")], "case_id int, warning string")
    got = [tuple(r)[1:] for r in evaluation.exposures(cases, contexts, related, warnings).orderBy("case_id").collect()]
    assert got == [(1.0, 1.0, False), (0.0, 1.0, True), (1.0, 1.0, False), (1.0, 0.0, False)]
    rows = spark.createDataFrame([(False, 1, 0, False, None, False), (False, 0, 1, True, None, False), (True, 1, 1, True, None, True), (True, 1, 0, True, None, True), (True, 0, 0, False, "no_terms", False), (True, 0, 0, False, None, False), (True, 2, 0, False, None, False), (True, 2, 0, False, None, True)], "e boolean, n int, v int, m boolean, s string, h boolean")
    got = [r[0] for r in rows.select(evaluation.verdict(*map(F.col, "envmsh"))).collect()]
    assert got == ["unexpected_evidence", None, "contract_violation", "relationship_miss", "no_terms", "candidate_miss", "ranking_miss", None]


def test_answers_and_their_pages(spark):
    kind = "question string, answer string, analysis string, title string, notes array<string>, citations array<struct<claim_id:string,source_id:string,locator:string,page_path:string>>"
    cited = [("c1", "s1", "line:1", "wiki/a.md"), ("c2", "s1", "line:2", "wiki/a.md")]
    rows = spark.createDataFrame([("Why?", "So.", "", " ", ["Maybe"], cited), ("??", "", "", "", [], cited[:1]), ("no", "x", "", "", [], [])], kind)
    first, second = answers.synthesis_pages(rows).orderBy("title").collect()[::-1]
    assert (first.page_id, first.target_path) == ("synthesis-why", "wiki/syntheses/why.md") and len(first.links) == 1
    assert "## Analysis\n\nSo.\n\n## Uncertainties\n\n- Maybe\n" in first.content
    assert second.page_id.startswith("synthesis-answer-") and "No answer produced." in second.content
    steps = spark.createDataFrame([("planning_failed", 1, True, 0, 1), ("planned", None, True, 0, 1), ("planned", 1, None, 0, 1), ("planned", 1, True, 1, 1), ("planned", 1, True, 0, 0), ("planned", 1, True, 0, 1)], "p string, n int, r boolean, b int, c int")
    got = [r[0] for r in steps.select(answers.answer_status(*map(F.col, "pnrbc"))).collect()]
    assert got == ["planning_failed", "planned_insufficient_evidence", "llm_failed", "invalid_citations", "invalid_citations", "answered"]


def test_index_status(spark):
    now = spark.createDataFrame([("f",)], "fingerprint string")
    status = lambda *rows: tuple(assembly.index_status(spark.createDataFrame(list(rows), "catalog_fingerprint string, chunk_count long"), now).first())
    assert status(("f", 3)) == (True, False, 3, None) and status(("old", 3)) == (True, True, 3, None) and status() == (False, True, 0, "missing_index")
