"""The catalog and the retrieval steps as DuckDB views, from which the queries' SQL is put together."""

from __future__ import annotations

import re

from .plans.catalog import ASIDE

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


_BARE = strip(r"regexp_replace(" + strip("text") + r", '^[-*+]\s+', '')")

VIEWS: dict[str, str] = {
    "v_first": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "v_marks": "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1",
    "v_lines0": "SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents SEMI JOIN v_first USING (doc_id)",
    "v_lines1": "SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1)::BIGINT AS line FROM v_lines0",
    "v_title": rf"""SELECT doc_id, CASE WHEN starts_with(t, '# ') THEN {strip("substr(t, 3)")} ELSE substr(t, 1, 80) END AS title
      FROM (SELECT doc_id, arg_min(t, line) AS t FROM (SELECT doc_id, line, {strip("text")} AS t FROM v_lines1) WHERE t <> '' GROUP BY 1)""",
    "v_sources": """SELECT 'src_' || substr(f.sha256, 1, 12) AS source_id, f.sha256, f.copies, d.doc_id, d.text, d.lang, d.source, coalesce(t.title, 'Untitled Source') AS title,
      'concept:' || d.lang || '-' || d.source AS concept_id, m.quality, m.toxic
      FROM v_first f JOIN documents d USING (doc_id) LEFT JOIN v_title t USING (doc_id) LEFT JOIN v_marks m USING (doc_id)""",
    "v_lines2": rf"""SELECT s.source_id, l.line, l.text, nullif({strip(r"regexp_extract(l.text, '^\s{0,3}#{1,6}\s+(.+?)\s*$', 1)")}, '') AS heading FROM v_lines1 l JOIN v_sources s USING (doc_id)""",
    "v_lines3": rf"SELECT *, heading IS NULL AND {strip('text')} <> '' AS body FROM v_lines2",
    "v_lines4": "SELECT *, body AND NOT coalesce(lag(body) OVER (PARTITION BY source_id ORDER BY line), false) AS starts FROM v_lines3",
    "v_lines": """SELECT source_id, line, text, last_value(heading IGNORE NULLS) OVER w AS section, CASE WHEN body THEN (sum(starts::INT) OVER w)::INT END AS paragraph
      FROM v_lines4 WINDOW w AS (PARTITION BY source_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_claim_lines": rf"""SELECT * FROM (SELECT *, {strip("text")} AS t, {_BARE} AS bare FROM v_lines)
      WHERE NOT starts_with(t, '#') AND NOT starts_with(t, '[unsupported-') AND bare <> '' AND NOT regexp_matches(lower(bare), '^(topic:|created for:|author:|date:|source:|tags:|status:|title:)')
      AND regexp_replace(lower(bare), '^[ .:-]+|[ .:-]+$', '', 'g') NOT IN ('contents', 'table of contents', 'introduction', 'scope', 'overview')
      AND NOT ends_with(bare, ':') AND regexp_matches(bare, '\p{{L}}') AND len(regexp_extract_all(bare, '\S+')) >= 4""".replace("{{", "{").replace("}}", "}"),
    "v_claims": """SELECT 'clm_' || source_id || '_' || line AS claim_id, source_id, t AS claim_text,
      concat_ws(';', 'line:' || line, 'section:' || section, 'paragraph:' || paragraph) AS citation_locator, line,
      CASE quality WHEN 1 THEN 'cited' WHEN 0 THEN 'weak' ELSE 'uncited' END AS confidence_status, '2026-01-01T00:00:00+00:00' AS created_at
      FROM v_claim_lines JOIN (SELECT source_id, quality FROM v_sources) USING (source_id)""",
    "v_concepts": "SELECT DISTINCT concept_id, lang, source, concat_ws(' ', lang, source) AS title FROM v_sources",
    "v_pages": r"""SELECT source_id AS page_id, 'wiki/sources/' || source_id || '.md' AS path, 'source' AS page_type, title FROM v_sources
      UNION ALL SELECT concept_id, 'wiki/concepts/' || regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g') || '.md', 'concept', title FROM v_concepts""",
    "v_aliases": r"""SELECT alias, 'concept' AS target_type, concept_id AS target_id, regexp_replace(lower(alias), '[^\p{L}\p{N}]', '', 'g') AS normalized_alias
      FROM (SELECT concept_id, unnest([title, lang, source]) AS alias FROM v_concepts)""",
    "v_links": "SELECT source_id AS from_page, concept_id AS to_page, 'mentions' AS link_type FROM v_sources UNION ALL SELECT concept_id, source_id, 'supports' FROM v_sources",
    "v_relationships": """SELECT concept_id AS subject_id, source_id AS object_id, CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS relationship_type, evidence_claim_id, source_id
      FROM v_sources JOIN (SELECT source_id, arg_min(claim_id, line) AS evidence_claim_id FROM v_claims GROUP BY 1) USING (source_id)""",
    "v_q": f"SELECT item_id AS query_id, coalesce(text, '') || '{ASIDE}' AS question FROM benchmark",
    "v_cat": """SELECT query_id, alias AS term, row_number() OVER (PARTITION BY query_id ORDER BY length(alias) DESC, alias) AS pos
      FROM v_q, (SELECT DISTINCT alias FROM v_aliases) WHERE contains(lower(question), lower(alias))""",
    "v_words": "SELECT query_id, unnest(ws) AS term, 100000 + generate_subscripts(ws, 1) AS pos FROM (SELECT query_id, regexp_extract_all(question, '[A-Za-z0-9_]{2,}') AS ws FROM v_q)",
    "v_terms": "SELECT query_id, term, min(pos) AS pos FROM (FROM v_cat UNION ALL FROM v_words UNION ALL SELECT query_id, '保存', 1000000 FROM v_q) GROUP BY 1, 2",
    "v_expanded": "SELECT query_id, unnest(e) AS term, 2000000 + generate_subscripts(e, 1) AS pos FROM (SELECT query_id, ['冷藏', '储存', '存放', '久放', '尽快食用', '保持干燥'] AS e FROM v_q)",
    "v_formula": r"""SELECT query_id, replace(f, ' ', '') AS term, min(n) AS pos FROM (SELECT query_id, unnest(fs) AS f, 4000000 + generate_subscripts(fs, 1) AS n FROM (
      SELECT query_id, regexp_extract_all(question, '(?i)\b[A-Z][A-Z0-9]*\b(?:\s*[=+\-*/^]\s*[A-Z0-9]+)+|\b[A-Z][A-Z0-9]*[0-9][A-Z0-9]*\b') AS fs FROM v_q)) GROUP BY 1, 2""",
    "v_symbol": r"""SELECT query_id, s AS term, min(n) AS pos FROM (SELECT query_id, unnest(ss) AS s, 5000000 + generate_subscripts(ss, 1) AS n FROM (
      SELECT query_id, list_concat(['α/β'], regexp_extract_all(question, '[\p{So}\p{Sm}\p{Sc}\p{Sk}]')) AS ss FROM v_q)) GROUP BY 1, 2""",
    "v_weights": """SELECT query_id, term, c OR e AS span, CASE WHEN x THEN 0.25::DOUBLE WHEN t AND NOT c THEN 0.2 WHEN e THEN 0.2 WHEN c THEN 0.05 WHEN length(term) >= 2 THEN 0.03 ELSE 0 END AS w FROM (
      SELECT query_id, term, bool_or(k = 'x') AS x, bool_or(k = 't') AS t, bool_or(k = 'c') AS c, bool_or(k = 'e') AS e FROM (
        SELECT query_id, term, 't' AS k FROM v_terms UNION ALL SELECT query_id, term, 'x' FROM v_expanded UNION ALL SELECT query_id, term, 'c' FROM v_cat
        UNION ALL SELECT query_id, term, 'e' FROM v_formula UNION ALL SELECT query_id, term, 'e' FROM v_symbol) GROUP BY 1, 2)""",
    "v_search": """SELECT query_id, term, lower(term) AS low, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM (SELECT query_id, term, min(pos) AS pos FROM (
      FROM v_terms UNION ALL FROM v_expanded UNION ALL SELECT query_id, term, 3000000 + pos FROM v_cat UNION ALL FROM v_formula) GROUP BY 1, 2)""",
    "v_asked": r"SELECT query_id, low AS term, count(*) AS times FROM v_search WHERE regexp_full_match(term, '[\p{L}\p{N}\p{M}_]+') GROUP BY 1, 2",
    "v_low": "SELECT claim_id, source_id, created_at, lower(claim_text) AS low, lower(claim_text || ' ' || citation_locator) AS both_low, lower(claim_text || chr(10) || citation_locator || chr(10) || title) AS named FROM v_claims JOIN v_sources USING (source_id)",
    "v_hit": "SELECT claim_id, term FROM v_low, (SELECT DISTINCT lower(term) AS term FROM v_weights) WHERE contains(both_low, term)",
    "v_bonus": "SELECT query_id, claim_id, sum(w) AS bonus FROM v_hit JOIN (SELECT query_id, lower(term) AS term, sum(w) AS w FROM v_weights GROUP BY 1, 2) USING (term) GROUP BY 1, 2",
    "v_tokens": r"SELECT claim_id, list_filter(regexp_split_to_array(lower(claim_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tokens FROM v_claims",
    "v_stats": "SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM v_tokens",
    "v_postings": "SELECT term, claim_id, dl, count(*) AS tf FROM (SELECT claim_id, len(tokens) AS dl, unnest(tokens) AS term FROM v_tokens) GROUP BY ALL",
    "v_df": "SELECT term, count(*) AS df FROM v_postings GROUP BY 1",
    "v_bm25": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, claim_id) AS rank FROM (
      SELECT query_id, claim_id, round(sum(times * greatest(1e-6, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
      FROM v_asked JOIN v_postings USING (term) JOIN v_df USING (term), v_stats GROUP BY 1, 2)) WHERE rank <= 640""",
    "v_like": """SELECT query_id, claim_id FROM (SELECT query_id, claim_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at, claim_id) AS n FROM (
      SELECT DISTINCT query_id, claim_id, created_at FROM v_low JOIN (SELECT DISTINCT query_id, low AS term FROM v_search WHERE n <= 20) ON contains(v_low.low, term))) WHERE n <= 640""",
    "v_scored": """SELECT c.query_id, c.claim_id, base, round(base + least(1.0::DOUBLE, coalesce(sum(w), 0)), 6) AS score FROM (SELECT query_id, claim_id, 1.0::DOUBLE AS base, 1000000 AS upto FROM v_bm25 UNION ALL SELECT query_id, claim_id, 0.5, 20 FROM v_like) c
      LEFT JOIN (SELECT h.claim_id, s.query_id, s.n, g.w FROM v_hit h JOIN v_search s ON h.term = s.low JOIN v_weights g ON g.query_id = s.query_id AND g.term = s.term) m
      ON m.query_id = c.query_id AND m.claim_id = c.claim_id AND n <= upto GROUP BY 1, 2, 3""",
    "v_text": "SELECT query_id, claim_id, source_id, source_id AS page_id, max(score) AS raw_score, max(base) AS base FROM v_scored JOIN v_claims USING (claim_id) GROUP BY 1, 2, 3",
    "v_edges": "SELECT from_page AS a, to_page AS b FROM v_links UNION ALL SELECT subject_id, object_id FROM v_relationships",
    "v_page_sources": """SELECT page_id, page_id AS source_id FROM v_pages WHERE page_type = 'source' UNION
      SELECT page_id, b FROM v_pages JOIN (SELECT a, b FROM v_edges UNION SELECT b, a FROM v_edges) ON page_id = a WHERE page_type <> 'source' AND starts_with(b, 'src_')""",
    "v_named": """SELECT query_id, page_id, max(s) AS s FROM (SELECT query_id, target_id AS page_id, 1.0::DOUBLE AS s FROM v_terms JOIN v_aliases ON normalized_alias = lower(term)
      UNION ALL SELECT query_id, page_id, 0.8 FROM (SELECT DISTINCT query_id, lower(term) AS term FROM v_terms) JOIN v_pages ON contains(lower(title), term)) GROUP BY 1, 2""",
    "v_alias": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, claim_id) AS rank FROM (
      SELECT query_id, claim_id, source_id, page_id, round(s + least(1.0::DOUBLE, coalesce(bonus, 0)), 6) AS raw_score FROM (
        SELECT query_id, source_id, arg_max(page_id, (s, page_id)) AS page_id, max(s) AS s FROM v_named JOIN v_page_sources USING (page_id) GROUP BY 1, 2)
      JOIN v_claims_kept USING (source_id) LEFT JOIN v_bonus USING (query_id, claim_id)) SEMI JOIN v_pages_kept USING (page_id)) WHERE rank <= 80""",
    "v_spans": "SELECT query_id, lower(term) AS term, w FROM v_weights WHERE span",
    "v_span_own": """SELECT query_id, claim_id, source_id, max(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY created_at, claim_id) AS n
      FROM v_low JOIN (SELECT DISTINCT term FROM v_spans) ON contains(named, term)) JOIN v_spans USING (term) WHERE n <= 320 GROUP BY 1, 2, 3""",
    "v_span_pages": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY page_type, title, page_id) AS n FROM (SELECT DISTINCT term, page_id, page_type, title FROM (
      SELECT page_id, page_type, title, lower(title) AS name FROM v_pages UNION ALL SELECT page_id, page_type, title, unnest([lower(alias), lower(normalized_alias)]) FROM v_pages JOIN v_aliases ON target_id = page_id)
      JOIN (SELECT DISTINCT term FROM v_spans) ON contains(name, term))) WHERE n <= 160""",
    "v_span_far": """SELECT query_id, claim_id, source_id, page_id, w FROM (SELECT query_id, source_id, max(page_id) AS page_id, max(w) AS w FROM v_span_pages JOIN v_spans USING (term) JOIN v_page_sources USING (page_id) GROUP BY 1, 2) JOIN v_claims USING (source_id)""",
    "v_span": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, claim_id) AS rank FROM (
      SELECT query_id, claim_id, source_id, arg_min(page_id, (-s, place, page_id)) AS page_id, max(s) AS raw_score FROM (SELECT query_id, claim_id, source_id, page_id, place, round(1.0::DOUBLE + least(1.0::DOUBLE, coalesce(bonus, w)), 6) AS s FROM (
        SELECT query_id, claim_id, source_id, source_id AS page_id, w, 0 AS place FROM v_span_own UNION ALL SELECT query_id, claim_id, source_id, page_id, w, 1 FROM v_span_far)
      LEFT JOIN v_bonus USING (query_id, claim_id)) GROUP BY 1, 2, 3) SEMI JOIN v_claims_kept USING (claim_id) SEMI JOIN v_pages_kept USING (page_id)) WHERE rank <= 80""",
    "v_near_sources": """SELECT query_id, source_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS n FROM (
      SELECT item_id AS query_id, source_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
      FROM benchmark JOIN embeddings q ON q.vec_id = item_id, v_sources JOIN embeddings e ON e.vec_id = doc_id) WHERE score > 0) WHERE n <= 640""",
    "v_vectors": """SELECT * FROM (SELECT query_id, claim_id, source_id, source_id AS page_id, round(0.8::DOUBLE * score, 6) AS raw_score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(0.8::DOUBLE * score, 6) DESC, claim_id) AS rank FROM v_near_sources JOIN v_claims_kept USING (source_id)) WHERE rank <= 80""",
    "v_claims_kept": "FROM v_claims",
    "v_pages_kept": "FROM v_pages",
    "v_lists": """SELECT 0 AS place, query_id, claim_id, source_id, page_id, raw_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, claim_id) AS rank FROM v_text SEMI JOIN v_claims_kept USING (claim_id) SEMI JOIN v_pages_kept USING (page_id)) WHERE rank <= 80
      UNION ALL SELECT 1, query_id, claim_id, source_id, page_id, raw_score, rank FROM v_alias
      UNION ALL SELECT 2, query_id, claim_id, source_id, page_id, raw_score, rank FROM v_span
      UNION ALL SELECT 3, query_id, claim_id, source_id, page_id, raw_score, rank FROM v_vectors""",
    "v_seeds": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, claim_id) AS retriever_rank FROM (
      SELECT query_id, claim_id, source_id, arg_max(page_id, (raw_score, -place)) AS page_id, max(raw_score) AS raw_score, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM v_lists GROUP BY 1, 2, 3)""",
    "v_keys": "SELECT DISTINCT query_id, unnest([claim_id, source_id, page_id]) AS key FROM v_seeds",
    "v_sides": "SELECT unnest([subject_id, object_id, evidence_claim_id, source_id]) AS key, [subject_id, object_id, source_id] AS nodes FROM v_relationships",
    "v_near": "SELECT DISTINCT query_id, node AS source_id FROM (SELECT query_id, unnest(nodes) AS node FROM v_keys JOIN v_sides USING (key)) WHERE starts_with(node, 'src_')",
    "v_graph": """SELECT * FROM (SELECT query_id, claim_id, source_id, source_id AS page_id, 0.4::DOUBLE AS raw_score, row_number() OVER (PARTITION BY query_id ORDER BY claim_id) AS rank
      FROM v_near JOIN v_claims_kept USING (source_id) ANTI JOIN v_seeds USING (query_id, claim_id)) WHERE rank <= 80""",
    "v_hybrid": """SELECT h.*, c.claim_text, c.citation_locator, c.confidence_status FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, claim_id) AS retriever_rank FROM (
      SELECT query_id, claim_id, source_id, arg_max(page_id, (raw_score, -place)) AS page_id, max(raw_score) AS raw_score, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, bool_or(place = 3) AS semantic
      FROM (SELECT * FROM v_lists UNION ALL SELECT 4, query_id, claim_id, source_id, page_id, raw_score, rank FROM v_graph) GROUP BY 1, 2, 3)) h JOIN v_claims c USING (claim_id) WHERE retriever_rank <= 80""",
    "v_duplicates": rf"""SELECT *, {strip(r"regexp_replace(lower(claim_text), '\s+', ' ', 'g')")} AS redundancy_group FROM v_hybrid""",
    "v_reranked0": "SELECT *, row_number() OVER (PARTITION BY query_id, redundancy_group ORDER BY raw_score DESC, retriever_rank, claim_id) - 1 AS duplicate_index FROM v_duplicates",
    "v_reranked1": """SELECT *, round(greatest(0, 0.65::DOUBLE * least(greatest(raw_score, 0), 1) + 0.2::DOUBLE / (retriever_rank + 1) + CASE confidence_status WHEN 'cited' THEN 0.18::DOUBLE ELSE -0.18::DOUBLE END
      + CASE WHEN citation_locator <> '' THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN semantic THEN 0.03::DOUBLE ELSE 0 END) * CASE WHEN duplicate_index > 0 THEN 0.7::DOUBLE ELSE 1 END, 6) AS rerank_score FROM v_reranked0""",
    "v_reranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retriever_rank, claim_id) AS candidate_rank FROM v_reranked1",
    "v_related": """SELECT DISTINCT query_id, h.claim_id, r.subject_id, r.object_id, r.relationship_type, r.evidence_claim_id, r.source_id AS r_source
      FROM v_hybrid h JOIN v_relationships r ON r.evidence_claim_id = h.claim_id OR r.source_id = h.source_id""",
}


def build(body: str, instead: dict[str, str] | None = None) -> str:
    """The body with all views that it names, in order; ``instead`` has other bodies for some."""
    views = VIEWS | (instead or {})
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+\b", text)):
            if name not in wanted:
                need(views[name])
                wanted.append(name)

    need(body)
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({views[name]})" for name in wanted) + "\n" + body if wanted else body
