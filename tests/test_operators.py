import math
import random

import pytest
from pyspark.sql import functions as F

from citewell import queries
from citewell.functions import query_terms as Q
from citewell.operators import assembly, evaluation, ingest, quality, retrieval, selection, upsert
from citewell.plans import catalog as C
from citewell.sources import documents as D

POOL = "query_id int, claim_id string, source_id string, page_id string, claim_text string, citation_locator string, confidence_status string, raw_score double, retriever_rank int"
RANKED = "query_id int, claim_id string, source_id string, page_id string, claim_text string, confidence_status string, rerank_score double, candidate_rank int, mode string, contradiction boolean"


def test_fusion_of_two_lists(spark):
    kind = "query_id int, claim_id string, source_id string, page_id string, raw_score double, reasons array<string>, retriever string"
    a = spark.createDataFrame([(1, "same", "s", "p1", 0.5, ["bm25_fts"], "bm25_fts")], kind)
    b = spark.createDataFrame([(1, "same", "s", "p2", 0.9, ["alias_exact:same"], "catalog_title_alias")], kind)
    row = retrieval.fused([a, b], 10).collect()
    assert len(row) == 1 and row[0].rrf == 0.032787 and row[0].page_id == "p2"
    assert row[0].retrievers == ["bm25_fts", "catalog_title_alias"] and row[0].reasons == ["bm25_fts", "alias_exact:same"]


def test_rerank_scores(spark):
    rows = [(1, "weak", "a", "a", "x", "line:1", "weak", 0.9, 1), (1, "cited", "b", "b", "y", "line:1", "cited", 0.8, 2), (2, "one", "a", "a", "same text", "line:1", "cited", 0.8, 1), (2, "two", "b", "b", "Same  text", "line:1", "cited", 0.8, 2)]
    got = {r.claim_id: (r.rerank_score, r.candidate_rank) for r in selection.reranked(spark.createDataFrame(rows, POOL)).collect()}
    assert got == {"cited": (0.806667, 1), "weak": (0.545, 2), "one": (0.84, 1), "two": (0.564667, 2)}


def test_embedding_rerank(spark):
    rows = [(1, "vitamin", "a", "a", "v", "line:1", "cited", 0.9, 1), (1, "storage", "a", "a", "s", "line:1", "cited", 0.2, 2)]
    near = spark.createDataFrame([(1, "storage", 1.0)], "query_id int, claim_id string, similarity double")
    got = selection.embedding_reranked(selection.reranked(spark.createDataFrame(rows, POOL)), near).orderBy("candidate_rank").collect()
    assert [(r.claim_id, r.rerank_score) for r in got] == [("storage", 0.811142), ("vitamin", 0.35)]


def ranked(rows, mode="broad"):
    out = []
    for i, (claim, source, score, *rest) in enumerate(sorted(rows, key=lambda r: -r[2])):
        extra = dict(zip(("page", "text", "status", "against"), rest, strict=False))
        out.append((1, claim, source, extra.get("page") or source, extra.get("text") or claim, extra.get("status") or "cited", score, i + 1, mode, bool(extra.get("against"))))
    return out


def picked(spark, rows, mode, **options):
    return [(r.claim_id, r.selection_reason) for r in selection.select_evidence(spark.createDataFrame(ranked(rows, mode), RANKED), **options).orderBy("rank").collect()]


def test_selection_fixtures(spark):
    ids = lambda *a, **k: [c for c, _ in picked(spark, *a, **k)]
    a3 = [("a1", "a", 0.99), ("a2", "a", 0.98), ("a3", "a", 0.97), ("b1", "b", 0.5)]
    assert ids(a3, "broad", limit=3, per_source=2) == ["a1", "b1", "a2"]
    berries = [("s1", "s", 0.95), ("s2", "s", 0.92), ("s3", "s", 0.9), ("o", "o", 0.89), ("b", "b", 0.88)]
    assert ids(berries, "focused", limit=3, per_source=5) == ["s1", "s2", "s3"]
    fruit = picked(spark, [("s", "s", 0.95), ("o", "o", 0.89), ("b", "b", 0.88)], "focused", limit=3, per_source=5, focus_least=3)
    assert [c for c, _ in fruit] == ["s", "o", "b"] and fruit[1][1] == "fill_after_focused_evidence_exhausted"
    assert ids([("a1", "a", 0.9, None, "same"), ("a2", "a", 0.89, None, "Same "), ("b1", "b", 0.5)], "broad", limit=3) == ["a1", "b1"]
    against = [("primary", "a", 0.95), ("other", "c", 0.8), ("conflict", "b", 0.2, None, None, None, True)]
    assert ids(against, "conflict", limit=2, per_source=2) == ["primary", "conflict"]
    topic = picked(spark, [("weak", "a", 0.99, "concept_topic", None, "weak"), ("cited", "b", 0.7, "concept_topic")], "broad", limit=1, per_source=2)
    assert topic == [("cited", "best_cited_for_coverage")]


def greedy(rows, mode, limit, cap, least):
    """A plain picking loop over one pool of rows by rank."""
    seen, pool = set(), []
    for r in rows:
        if r[4].lower() not in seen:
            seen.add(r[4].lower())
            pool.append(r)
    group = lambda r: f"source:{r[2]}" if r[3].startswith("src_") else r[3]
    chosen, used = [], {}

    def take(r, forced=False):
        if r not in chosen and (forced or used.get(r[2], 0) < cap):
            chosen.append(r)
            used[r[2]] = used.get(r[2], 0) + 1

    if mode == "focused" and pool:
        home = [r for r in pool if group(r) == group(pool[0])]
        cited = [r for r in home if r[5] == "cited"]
        enough = len(cited) >= min(limit, least)
        for r in cited or home:
            take(r, enough)
        if not enough:
            for r in pool:
                if group(r) != group(pool[0]):
                    take(r)
    elif pool:
        if mode == "conflict":
            take(pool[0], True)
            for r in pool:
                if r[9]:
                    take(r, True)
        best = {}
        for r in pool:
            best.setdefault(group(r), []).append(r)
        for members in best.values():
            take(min(members, key=lambda r: (r[5] != "cited", -r[6], r[1])))
        for r in pool:
            take(r)
    return [r[1] for r in chosen[:limit]]


def test_selection_equals_a_picking_loop(spark):
    rng, pools = random.Random(5), []
    for q in range(300):
        mode = rng.choice(["broad", "focused", "conflict"])
        rows = [(f"c{i}", f"src_{rng.randrange(4)}", rng.randrange(100) / 100, rng.choice(["p1", "p2", "src_x"]), f"text {rng.randrange(9)}", rng.choice(["cited", "weak"]), rng.random() < 0.2) for i in range(rng.randrange(1, 12))]
        pools.append([(q, *r[1:]) for r in ranked(rows, mode)])
    for limit, cap in ((3, 2), (8, 1), (5, 3)):
        frame = spark.createDataFrame([r for p in pools for r in p], RANKED)
        got = {}
        for r in selection.select_evidence(frame, limit, cap).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.claim_id)
        for p in pools:
            assert got.get(p[0][0], []) == greedy(p, p[0][8], limit, cap, 3), p


def test_modes(spark):
    rows = spark.createDataFrame([(["a"], False, None, None), ([], True, None, None), (["a", "b"], False, None, None), ([], False, None, "x"), (["a"], True, "odd", None), ([], False, None, None)], "t array<string>, c boolean, f string, s string")
    got = [r[0] for r in rows.select(selection.mode(F.col("t"), F.col("c"), F.col("f"), F.col("s"))).collect()]
    assert got == ["focused", "conflict", "comparison", "focused", "broad", "broad"]


def seeded(spark):
    make = lambda name, rows: spark.createDataFrame(rows, C.schema(name))
    texts = [("c1", "src_w", "Boiling H₂O leaves salt behind in the pan."), ("c2", "src_w", "Keep the α/β balance under control."), ("c3", "src_b", "蓝莓洗净后冷藏，两天内吃完。"), ("c4", "src_p", "梨含有膳食纤维和水分。")]
    names = {"src_w": "Kitchen lab", "src_b": "蓝莓", "src_p": "梨"}
    return C.Catalog(
        make("sources", [(s, t, *[None] * 7) for s, t in names.items()]),
        make("claims", [(c, s, t, "line:2", "cited" if c != "c4" else "weak", "t") for c, s, t in texts]),
        make("aliases", [("berry", "concept", "concept:fruit", "berry")]),
        make("pages", [(s, "", "source", t, "[]", "t") for s, t in names.items()] + [("concept:fruit", "", "concept", "Fruit", "[]", "t")]),
        make("links", [("src_b", "concept:fruit", "mentions")]),
        make("relationships", [("concept:fruit", "src_p", "supports", "c4", "src_p")]),
    )


def test_seeded_retrievers(spark):
    c = seeded(spark)
    rows = [(1, "what does H₂O leave, and the α/β balance"), (2, "蓝莓怎么保存"), (3, "berry_salt behind_in")]
    asked = Q.analyze(spark.createDataFrame(rows, "query_id int, question string"), spark.createDataFrame([("蓝莓",), ("berry",), ("Fruit",)], "term string"))
    best = lambda found, q: {r.claim_id: r.raw_score for r in found.filter(F.col("query_id") == q).collect()}
    assert {"c1", "c2"} <= set(best(retrieval.full_text(asked, c.claims, 5), 1))
    hits = {(r.query_id, r.claim_id) for r in retrieval.bm25(asked, c.claims, 5).collect()}
    assert (3, "c1") in hits and len([h for h in hits if h[0] == 3]) == 1  # behind_in is a phrase
    spans = retrieval.exact_span(asked, c, 20)
    assert set(best(spans, 1)) == {"c1", "c2"} and best(spans, 2).keys() == {"c3"}
    assert best(spans, 3) == {"c3": 1.05, "c4": 1.05}  # by the page of the alias; the span alone adds its weight
    # 蓝莓 is a catalog term, 冷藏 one of the synonyms of 保存
    assert best(retrieval.substring(asked, c.claims, 20), 2) == {"c3": 0.8} and best(retrieval.alias_title(asked, c, 20), 2) == {"c3": 1.1}
    assert best(retrieval.alias_title(asked, c, 20), 3) == {"c3": 1.0, "c4": 1.0}
    near = spark.createDataFrame([(1, "claim:c4", 0.9), (2, "source_title:src_w", 0.5)], "query_id int, chunk_id string, score double")
    rows = retrieval.hybrid(asked, c, 10, 10, near).collect()
    assert ["vector"] in [r.retrievers for r in rows if (r.query_id, r.claim_id) == (1, "c4")]
    assert {r.claim_id for r in retrieval.hybrid(asked, c, 10, 10, near, {"confidence": "weak"}).collect()} == {"c4"}
    assert not retrieval.hybrid(asked, c, 10, 10, near, {"page_type": "concept", "source_id": "src_w"}).collect()
    assert retrieval.filtered(c.claims, c, confidence="").count() == 4


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "k string, v int")
    pairs = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert pairs(upsert.insert_ignore(old, new, "k")) == [("a", 1), ("b", 1), ("c", 2)]
    assert pairs(upsert.upsert(old, new.distinct(), "k")) == [("a", 1), ("b", 2), ("c", 2)]
    assert pairs(upsert.staged_first(new.distinct(), old, "k")) == [("a", 1), ("b", 2), ("c", 2)]


def test_anchors_and_claims(spark):
    text = "# Notes\n- Topic:\n- Introduction\n\n## Practice\nFirst sentence has enough words.\nSecond sentence has enough words.\n\nonly three words"
    sources = D.import_sources(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id int, text string"))
    assert sources.count() == 1 and sources.first().title == "Notes"
    got = [(r.line, r.citation_locator) for r in D.claims(sources).orderBy("line").collect()]
    assert got == [(6, "line:6;section:Practice;paragraph:2"), (7, "line:7;section:Practice;paragraph:2")]


def test_schema_problems(spark):
    relations = C.empty(spark)
    assert C.problems(relations) == []
    relations["links"] = relations["links"].select("to_page", "from_page", "link_type")
    del relations["pages"]
    assert C.problems(relations) == ["missing pages", "links has to_page, from_page, link_type"]


def test_json_lines_report_their_errors(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"id": "a"}\n\n{broken\n')
    rows = D.read_json_lines(spark, str(tmp_path / "cases.jsonl"), "id string").orderBy("line").collect()
    assert [(r.line, r.id, r.error) for r in rows] == [(1, "a", None), (3, None, "cases.jsonl:3: not JSON")]


def test_long_proposals_have_an_id_for_each_claim(spark):
    rows = spark.createDataFrame([("src_a", [(f"Claim {i}", "line:1", "cited") for i in range(1200)])], "source_id string, claims array<struct<text:string,locator:string,confidence:string>>")
    got = ingest.numbered_proposal(rows).select("claim_id").distinct()
    assert got.count() == 1200 and {"clm_src_a_llm_007", "clm_src_a_llm_1200"} <= {r[0] for r in got.collect()}


def test_proposals_and_pages(spark):
    proposal = spark.createDataFrame([("src_a", [("One", "line:1", "cited"), (" ", "line:2", "cited"), ("Two", "", "cited")])], "source_id string, claims array<struct<text:string,locator:string,confidence:string>>")
    got = [(r.claim_id, r.confidence_status) for r in ingest.numbered_proposal(proposal).orderBy("claim_id").collect()]
    assert got == [("clm_src_a_llm_001", "cited"), ("clm_src_a_llm_003", "weak")]


def test_drift_and_fingerprint(spark):
    sources = spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, sha256 string")
    assert quality.hash_drift(sources, spark.createDataFrame([("a", "t")], "source_id string, text string")).count() == 2
    again = quality.fingerprint(sources.orderBy(F.desc("source_id")).repartition(3), ["source_id", "sha256"]).first()
    assert again == quality.fingerprint(sources, ["source_id", "sha256"]).first() and again.rows == 2


def test_stream_imports_each_content_once(spark, tmp_path):
    from citewell.streaming.incremental import import_stream

    where = tmp_path / "in"
    for k, rows in enumerate(([(1, "a b c d"), (2, "a b c d")], [(3, "a b c d"), (4, "new text")])):
        spark.createDataFrame(rows, "doc_id int, text string").write.mode("append").parquet(str(where))
        stream = spark.readStream.schema("doc_id int, text string").parquet(str(where))
        import_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1


def test_entity_named_across_claims(spark):
    rows = [("a", 1, "we use open"), ("a", 2, "。"), ("a", 3, "AI models"), ("b", 1, "open"), ("b", 2, "x ai"), ("c", 1, None), ("d", 1, "OpenAI"), ("d", 2, "Open-AI")]
    got = ingest.entities(spark.createDataFrame(rows, "source_id string, line int, claim_text string")).collect()
    assert sorted((r.source_id, r.entity_title, tuple(r.entity_aliases)) for r in got) == [(s, "OpenAI", ("OpenAI", "Open AI", "Open-AI")) for s in "ad"]


def test_proposals_come_before_what_is_inferred(spark):
    sources = spark.createDataFrame([("a", "Storage: a guide"), ("b", "Fruit notes"), ("c", "Rag paper"), ("d", "水：保存: x")], "source_id string, title string")
    claims = spark.createDataFrame([("c", 1, "RAG works"), ("b", 1, "OpenAI too")], "source_id string, line int, claim_text string")
    kind = "source_id string, concept_title string, concept_aliases array<string>, entity_title string, entity_aliases array<string>"
    given = [("a", "storage a guide", ["Keep", "keep!", "Storage: a guide"], "Box", []), ("b", "", None, None, None), ("d", "水：保存: x", None, "", ["unused"])]
    got = {r.source_id: tuple(r)[1:] for r in ingest.proposed(spark.createDataFrame(given, kind), sources, claims).collect()}
    assert got == {
        "a": ("Storage", ["Storage", "Keep"], "Box", ["Box"]),
        "b": ("Fruit", ["Fruit"], "OpenAI", ["OpenAI", "Open AI", "Open-AI"]),
        "c": ("Retrieval Augmented Generation", ["RAG", "retrieval augmented generation"], None, None),
        "d": ("水", ["水"], None, None),
    }


def test_rerank_falls_back(spark):
    pool = spark.createDataFrame([(1, "x", "a", "a", "v", "line:1", "cited", 0.9, 1), (1, "y", "a", "a", "s", "line:1", "cited", 0.2, 2)], POOL)
    near = spark.createDataFrame([(1, "y", 1.0)], "query_id int, claim_id string, similarity double")
    first = lambda rows: rows.filter("candidate_rank = 1").select("claim_id", "method", "warning").first()
    assert tuple(first(selection.dispatched(pool, "embedding", near))) == ("y", "embedding", None)
    assert tuple(first(selection.dispatched(pool, "embedding"))) == ("x", "deterministic", None)
    assert tuple(first(selection.dispatched(pool, "embedding", problem="Index is stale"))) == ("x", "deterministic", "Index is stale")
    assert tuple(first(selection.dispatched(pool, "provided")))[2] == "no scores were provided"


def test_runs_that_may_not_be_applied(spark):
    runs = spark.createDataFrame([("a", "staged"), ("b", "applied"), ("c", None), ("d", "reviewed")], "run_id string, status string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "run_id string")
    assert sorted(map(tuple, assembly.run_problems(asked, runs).collect())) == [("b", "status_applied"), ("e", "no_manifest")]


def spread_catalog(spark, seed=3, sources=40):
    """A catalog of random claims: two hubs name most sources, some sources have many claims, some texts hold few terms."""
    rng = random.Random(seed)
    words = ["rain", "wind", "snow", "sun", "fog", "hail", "dew", "frost", "heat", "ice"]
    claims, pages, links = [], [], []
    for n in range(sources):
        s = f"src_{rng.randrange(10**6):06d}"
        pages.append((s, "", "source", " ".join(rng.sample(words, 2)), "[]", "t"))
        links += [(s, "concept:hub", "mentions")] * (n % 3 > 0) + [(s, "concept:other", "mentions")] * (n % 4 == 0)
        for i in range(150 if n % 13 == 0 else rng.randrange(1, 12)):
            text = " ".join(rng.choices(words, k=rng.choice([1, 3, 9])) + [f"w{rng.randrange(40)}"])
            claims.append((f"clm_{s}_{i:03d}", s, text, f"line:{i}", rng.choice(["cited", "weak"]), f"t{rng.randrange(3)}"))
    pages += [("concept:hub", "", "concept", "Hub", "[]", "t"), ("concept:other", "", "concept", "Other", "[]", "t")]
    aliases = [("hub", "concept", "concept:hub", "hub"), ("other", "concept", "concept:other", "other"), ("weather", "concept", "concept:other", "weather")]
    make = lambda name, rows: spark.createDataFrame(rows, C.schema(name))
    named = [(p[0], p[3], *[None] * 7) for p in pages if p[0].startswith("src_")]
    return C.Catalog(make("sources", named), make("claims", claims), make("aliases", aliases), make("pages", pages), make("links", links), make("relationships", [])), words


def brute_alias(catalog, asked, limit, page_type=None, confidence=None):
    """The best claims of every question by looking at each pair of question and claim."""
    claims, pages = catalog.claims.collect(), {p.page_id: p for p in catalog.pages.collect()}
    edges, aliases = [(a.from_page, a.to_page) for a in catalog.links.collect()], {(a.target_id, a.normalized_alias) for a in catalog.aliases.collect()}
    out = {}
    for q in asked.collect():
        kinds = {c: list(getattr(q, c)) for c in retrieval.KINDS}
        total = {}
        for t in dict.fromkeys(x for k in retrieval.KINDS for x in kinds[k]):
            text, cat = t in kinds["text_terms"], t in kinds["catalog_terms"]
            w = 0.25 if t in kinds["expanded_terms"] else 0.2 if text and not cat or t in kinds["formula_spans"] + kinds["symbol_spans"] else 0.05 if cat else 0.03
            total[t.lower()] = total.get(t.lower(), 0) + w
        named = {}
        for p in pages.values():
            for t in {x.lower() for x in kinds["catalog_terms"] + kinds["text_terms"]}:
                base = 1.0 if (p.page_id, t) in aliases else 0.8 if t in p.title.lower() else 0
                for s in [p.page_id] if p.page_type == "source" else [a for a, b in edges if b == p.page_id]:
                    named[s] = max(named.get(s, (0, "")), (base, p.page_id)) if base else named.get(s, (0, ""))
        rows = []
        for c in claims:
            base, page = named.get(c.source_id, (0, ""))
            if base and (not page_type or pages[page].page_type == page_type) and (not confidence or c.confidence_status == confidence):
                text = f"{c.claim_text} {c.citation_locator}".lower()
                rows.append((-round(base + min(1.0, sum(w for t, w in total.items() if t in text)), 6), c.claim_id, page))
        out[q.query_id] = [(c, p, -s) for s, c, p in sorted(rows)[:limit]]
    return out


def test_threshold_equals_all_pairs_and_scores_few(spark):
    c, words = spread_catalog(spark)
    texts = ["hub " + " ".join(words), "hub rain", "rain snow", "other weather w3", "w39", "nothing here", "hub other " + " ".join(words[:6])]
    asked = Q.analyze(spark.createDataFrame(list(enumerate(texts)), "query_id int, question string"), spark.createDataFrame([("hub",), ("other",)], "term string"))
    index, seen = retrieval.build_index(c.claims), []
    for limit, filters in ((5, {}), (5, {"page_type": "source", "confidence": "cited"}), (300, {})):
        got = {q: [] for q in range(len(texts))}
        for r in retrieval.alias_title(asked, c, limit, filters, index, seen).orderBy("query_id", F.desc("raw_score"), "claim_id").collect():
            got[r.query_id].append((r.claim_id, r.page_id, r.raw_score))
        assert got == brute_alias(c, asked, limit, **filters), (limit, filters)


def test_threshold_scores_few_pairs_of_real_questions(spark):
    """Below a tenth of all pairs of question and claim, for aliases and for spans; before, nearly all were."""
    sf = "/root/testdata/sf0.01"
    c, asked, index = queries._stored(spark, sf), queries._questions(spark, sf), queries._index(spark, sf)
    pairs = asked.count() * c.claims.count()
    for retrieve in (retrieval.alias_title, retrieval.exact_span):
        seen = []
        assert retrieve(asked, c, 10, index=index, seen=seen).count() == 10 * asked.count()
        assert 10 * asked.count() <= sum(x.count() for x in seen) < 0.1 * pairs


def test_full_text_blocks_are_skipped_without_loss(spark, monkeypatch):
    from citewell.operators import index as I

    monkeypatch.setattr(I, "POSTINGS", 4)
    c, words = spread_catalog(spark, seed=9, sources=120)
    texts = ["w3 rain snow fog", "w7 w8 rain_wind", "rain", "sun_fog hail", "absent", " ".join(words) + " w1 w2"]
    asked = Q.analyze(spark.createDataFrame(list(enumerate(texts)), "query_id int, question string"))
    index = retrieval.build_index(c.claims)
    got = {(r.query_id, r.claim_id): (r.bm25, r.rank) for r in retrieval.bm25(asked, c.claims, 6, index).collect()}
    everything = {(r.query_id, r.claim_id): (r.bm25, r.rank) for r in retrieval.bm25(asked, c.claims, 10**6, index).collect()}
    assert got == {k: v for k, v in everything.items() if v[1] <= 6} and len(got) == 30
    # the scores by their formula
    rows = [(r.claim_id, r.claim_text.lower().split()) for r in c.claims.collect()]
    n, length = len(rows), sum(len(w) for _, w in rows) / len(rows)
    for q, terms in ((0, ["w3", "rain", "snow", "fog"]), (1, ["w7", "w8", "rain wind"]), (3, ["sun fog", "hail"])):
        line = {claim: f" {' '.join(w)} " for claim, w in rows}
        count = {t: {claim: sum(x.startswith(f" {t} ", i) for i in range(len(x))) for claim, x in line.items()} for t in terms}
        for claim, w in rows:
            score = 0.0
            for t in terms:
                df, tf = sum(v > 0 for v in count[t].values()), count[t][claim]
                score += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / length))
            assert (everything.get((q, claim), (0,))[0]) == pytest.approx(score, abs=2e-6)
    report = {r.query_id: r for r in retrieval.block_report(asked, c.claims, 6, index).collect()}
    assert report[0].skipped > 0 and report[0].skipped_postings < report[0].postings


def test_substrings_are_searched_in_the_first_claims_first(spark):
    c, _ = spread_catalog(spark, seed=2)
    asked = Q.analyze(spark.createDataFrame([(1, "rain wind snow sun fog hail"), (2, "w11"), (3, "absent")], "query_id int, question string"))
    order = sorted(c.claims.collect(), key=lambda r: (r.created_at, r.claim_id))
    for limit in (3, 40):
        got = retrieval.substring(asked, c.claims, limit).collect()
        for q, terms in ((1, ["rain", "wind", "snow", "sun", "fog", "hail"]), (2, ["w11"]), (3, ["absent"])):
            assert {r.claim_id for r in got if r.query_id == q} == {r.claim_id for r in [x for x in order if any(t in x.claim_text for t in terms)][:limit]}


def test_two_decimals(spark):
    values = [0.125, 0.285, 0.625, 0.155, 0.375, 0.0, 1.0, 0.005, 1234.565] + [k / 400 for k in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", evaluation.two_decimals(F.col("x")).alias("y")).collect()
    assert all(r.y == f"{r.x:.2f}" for r in rows) and rows[0].y == "0.12" and rows[1].y == "0.28"


def test_vector_search_hands_on_the_best_of_each_task(spark):
    import numpy as np

    from citewell.operators import vectors

    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    x[100:400] = x[7]  # ties by id
    odd = [(2000, []), (2001, [0.0] * 6), (2002, None), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, v array<double>")
    asked = rows.filter("id % 50 = 7 OR id >= 2000").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    chunks = rows.repartition(3).select(F.col("id").cast("string").alias("chunk_id"), F.col("v").alias("vector"))
    handed = vectors.nearest(asked, chunks, 5).groupBy("query_id").count().collect()
    assert len(handed) == 18 and all(r["count"] <= 3 * 5 for r in handed)
    got = {}
    for r in retrieval.vector(asked, chunks, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    for q in range(7, 900, 50):
        near = [(str(i), round(float(s), 6)) for i, s in enumerate(unit @ unit[q]) if i != q and round(float(s), 6) > 0]
        assert got[q] == sorted(near, key=lambda f: (-f[1], f[0]))[:5]
