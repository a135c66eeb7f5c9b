"""Retrievers: each turns a batch of questions into ranked candidates in one plan.

Fetch limits are ranks and come before filters; the limit of a list after them.
Alias, title and span candidates are found by a threshold algorithm: they come in
order of their base and id, and are scored only until no later one can be among
the best.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import in_blocks, keep
from . import matching, vectors
from .asked import KINDS, all_terms, asked_terms, holding, listed, matched_bonus, ranked, relevance, searchable, spans, weight_of
from .index import Index, block_report, bm25, build_index

#: The terms of a substring search, fusion.
LIKE_TERMS, RRF_K = 20, 60
#: Bases of scores.
FULL_TEXT, SUBSTRING, ALIAS, TITLE, SPAN, RELATED = 1.0, 0.5, 1.0, 0.8, 1.0, 0.4
CANDIDATE = ["query_id", "claim_id", "source_id", "page_id", "raw_score", "reasons", "retriever"]
#: Claims that a round of the threshold algorithm takes of a question, as multiples of the limit.
ROUNDS = (4, 32)


def first_by_id(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of the first claims by id of each key: a hub of the catalog hands on these alone."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("claim_id"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def with_claims(found: DataFrame, claims: DataFrame) -> DataFrame:
    wanted = ["claim_id", "source_id", "claim_text", "citation_locator", "confidence_status"]
    return found.join(claims.select("claim_id", *[c for c in wanted if c not in found.columns]), "claim_id")


def _scored(found: DataFrame, questions: DataFrame, terms: Column, base: float, retriever: str, reason: str) -> DataFrame:
    """Candidates scored by the terms that occur in claim and locator; the page is the source's."""
    weighed = F.transform(terms, lambda t: F.struct(F.lower(t).alias("term"), weight_of(questions, t).alias("weight")))
    rows = found.join(F.broadcast(questions.select("query_id", weighed.alias("asked"))), "query_id")
    score = relevance(base, matched_bonus(F.concat_ws(" ", "claim_text", "citation_locator"), F.col("asked")))
    page = F.col("source_id").alias("page_id")
    return rows.select("query_id", "claim_id", "source_id", page, score.alias("raw_score"), F.array(F.lit(reason)).alias("reasons"), F.lit(retriever).alias("retriever"))


@in_blocks
def full_text(questions: DataFrame, claims: DataFrame, limit: int, found: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The best claims by BM25, or those ``found`` by it."""
    best = bm25.__wrapped__(questions, claims, limit, index) if found is None else found.join(questions.select("query_id"), "query_id", "left_semi")
    return _scored(with_claims(best.select("query_id", "claim_id"), claims), questions, searchable(questions), FULL_TEXT, "bm25_fts", "bm25_fts")


@in_blocks
def substring(questions: DataFrame, claims: DataFrame, limit: int, index: Index | None = None) -> DataFrame:
    """Claims that contain any of the first terms, in order of creation and id up to the limit.

    The first claims of all, twice the limit, are searched for every question; the others only for questions that
    found too few there.
    """
    terms = F.slice(searchable(questions), 1, LIKE_TERMS)
    asked = keep(asked_terms(questions, terms), "asked")
    low = claims.select("claim_id", "created_at", F.lower("claim_text").alias("text")) if index is None else index.texts.select("claim_id", "created_at", F.col("low").alias("text"))

    def found(rows: DataFrame, asked: DataFrame) -> DataFrame:
        hits = holding(rows, asked, "claim_id").select("claim_id", "created_at", "query_id").distinct()
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("created_at", "claim_id"))
        return hits.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "claim_id", "place")

    first = keep(found(low.orderBy("created_at", "claim_id").limit(2 * limit), asked), "hits")
    full = keep(first.filter(F.col("place") == limit).select("query_id"), "full")
    others = asked.join(full, "query_id", "left_anti")
    best = first.join(full, "query_id", "left_semi")
    if not others.isEmpty():
        best = best.unionByName(found(low, others))
    return _scored(with_claims(best.select("query_id", "claim_id"), claims), questions, terms, SUBSTRING, "like", "like_match")


def folded(arrivals: DataFrame) -> DataFrame:
    """One row for each question and claim, from its arrivals (query_id, claim_id, source_id, page_id, raw_score, reasons, arrival) in order.

    An arrival with a higher score replaces what was there, reasons and page too; another one adds its reasons.
    Arrivals of one number go by page, then reasons.
    """
    steps = F.array_sort(F.collect_list(F.struct("arrival", "page_id", "raw_score", "reasons")))
    rows = arrivals.groupBy("query_id", "claim_id", "source_id").agg(steps.alias("steps"))
    state = F.struct(F.col("steps")[0]["page_id"].alias("page_id"), F.col("steps")[0]["raw_score"].alias("raw_score"), F.col("steps")[0]["reasons"].alias("reasons"))

    def step(s: Column, x: Column) -> Column:
        new = x["raw_score"] > s["raw_score"]
        reasons = F.when(new, x["reasons"]).otherwise(F.array_union(s["reasons"], x["reasons"]))
        return F.struct(F.when(new, x["page_id"]).otherwise(s["page_id"]).alias("page_id"), F.greatest(x["raw_score"], s["raw_score"]).alias("raw_score"), reasons.alias("reasons"))

    done = rows.select("query_id", "claim_id", "source_id", F.aggregate(F.slice("steps", 2, F.size("steps")), state, step).alias("s"))
    return done.select("query_id", "claim_id", "source_id", "s.page_id", "s.raw_score", "s.reasons")


def merged(*retrieved: DataFrame) -> DataFrame:
    """What one retriever holds after its lists have arrived in this order: see ``folded``."""
    rows = None
    for place, df in enumerate(retrieved):
        part = df.select(*CANDIDATE).withColumn("arrival", F.lit(place))
        rows = part if rows is None else rows.unionByName(part)
    return folded(rows)


def page_sources(pages: DataFrame, links: DataFrame, relationships: DataFrame) -> DataFrame:
    """page_id, source_id: a source page is its own; any other has its neighbours that are sources."""
    edges = links.select(F.col("from_page").alias("a"), F.col("to_page").alias("b")).unionByName(relationships.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = pages.filter(F.col("page_type") == "source").select("page_id", F.col("page_id").alias("source_id"))
    other = pages.filter(F.col("page_type") != "source").select("page_id").join(both.filter(F.col("b").startswith("src_")).distinct(), F.col("page_id") == F.col("a")).select("page_id", F.col("b").alias("source_id"))
    return own.unionByName(other).distinct()


def bonuses(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """source_id, claim_id, query_id, bonus of all claims that hold any term in text or locator; claims stay with their source."""
    text = F.lower(F.concat_ws(" ", "claim_text", "citation_locator")).alias("text")
    found = holding(claims.select("source_id", "claim_id", text), asked_terms(questions, all_terms(questions)), "source_id")
    return found.groupBy("source_id", "claim_id", "query_id").agg(F.sum("weight").alias("bonus"))


def _weighed(questions: DataFrame) -> DataFrame:
    """query_id, asked (all terms with their weights), most: what they can add together."""
    asked = F.transform(all_terms(questions), lambda t: F.struct(F.lower(t).alias("term"), weight_of(questions, t).alias("weight")))
    rows = questions.select("query_id", F.filter(asked, lambda t: F.trim(t["term"]) != "").alias("asked"))
    return rows.withColumn("most", F.least(F.lit(1.0), F.aggregate("asked", F.lit(0.0), lambda s, t: s + t["weight"])))


def _bonus(text: Column, asked: Column) -> Column:
    """What the matched terms add; null if none occurs."""
    any_of = F.exists(asked, lambda t: (t["weight"] == 0) & F.contains(text, t["term"]))
    return F.transform(F.array(matched_bonus(text, asked)), lambda b: F.when((b > 0) | any_of, b))[0]


def threshold(
    units: Callable[[int, DataFrame | None], DataFrame], score: Callable[[DataFrame], DataFrame], weighed: DataFrame, limit: int, unit: float,
    rest: Callable[[DataFrame], DataFrame], floor: float | None = None, seen: list[DataFrame] | None = None,
) -> DataFrame:
    """The best ``limit`` rows of each question by raw_score, then claim_id, without scoring all candidates.

    ``units(n, open)`` are the first n units (query_id, base, least, place, ...) of the open questions, all if None, in
    order of base and smallest claim; ``score`` gives the rows of some units (query_id, claim_id, raw_score, ...).
    A question is done when its last row comes before the next unit's smallest claim would with all terms matched, and
    before ``floor`` with all terms, the base of what the units leave out.  What isn't done after the rounds is
    answered by ``rest(open)``.  ``unit`` is how many rows a unit has on average; ``seen`` gets the scored pairs of each round.
    """
    open_, done = None, []
    for times in ROUNDS:
        size = 1 + int(times * limit / max(unit, 1.0))
        window = keep(units(size + 1, open_), "units")
        scored = score(window.filter(F.col("place") <= size))
        if seen is not None:
            seen.append(scored)
        rows = keep(ranked(scored, "raw_score", limit), "scored")
        last = rows.filter(F.col("rank") == limit).select("query_id", F.col("raw_score").alias("last"), F.col("claim_id").alias("last_claim"))
        after = weighed.join(window.filter(F.col("place") == size + 1).select("query_id", "base", "least"), "query_id").join(last, "query_id", "left")
        bound = relevance(F.col("base"), F.col("most"))
        unsafe = after.filter(F.col("last").isNull() | (F.col("last") < bound) | ((F.col("last") == bound) & (F.col("last_claim") > F.col("least")))).select("query_id")
        if floor is not None:
            below = weighed.join(last, "query_id", "left").filter(F.col("last").isNull() | (F.col("last") <= relevance(floor, F.col("most")))).select("query_id")
            unsafe = unsafe.unionByName(below if open_ is None else below.join(open_, "query_id", "left_semi")).distinct()
        unsafe = keep(unsafe, "open")
        done.append(rows.join(unsafe, "query_id", "left_anti"))
        open_ = unsafe
        if open_.isEmpty():
            break
    else:
        done.append(rest(open_).select(*done[0].columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _units(pages: DataFrame, catalog, index: Index, size: int, source_id: str | None = None) -> DataFrame:
    """page_id, source_id, slot, least: the first units of claims behind each of the pages, by smallest claim."""
    behind = page_sources(catalog.pages, catalog.links, catalog.relationships).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    behind = behind.filter(F.col("source_id") == source_id) if source_id else behind
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("least", "slot"))
    return behind.join(index.units, "source_id").withColumn("place", place).filter(F.col("place") <= size).drop("place")


def _own_units(named: DataFrame, catalog, index: Index, size: int, each: DataFrame) -> DataFrame:
    """named(query_id, page_id, base) with the first units behind each page: of the one source that a question asks for, or of all."""
    named = named.join(each.select("query_id", "want_source"), "query_id", "left")
    any_, one = named.filter("want_source IS NULL").drop("want_source"), named.filter("want_source IS NOT NULL")
    behind = page_sources(catalog.pages, catalog.links, catalog.relationships).withColumnRenamed("source_id", "want_source")
    pairs = one.select("page_id", "want_source").distinct().join(behind, ["page_id", "want_source"], "left_semi")
    place = F.row_number().over(Window.partitionBy("page_id", "want_source").orderBy("least", "slot"))
    units = pairs.join(index.units.withColumnRenamed("source_id", "want_source"), "want_source").withColumn("place", place).filter(F.col("place") <= size).drop("place")
    mine = one.join(units, ["page_id", "want_source"]).withColumnRenamed("want_source", "source_id")
    return any_.join(_units(any_, catalog, index, size), "page_id").unionByName(mine)


def _placed(units: DataFrame, size: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "least", "source_id", "slot"))
    return units.withColumn("place", place).filter(F.col("place") <= size)


def _of_open(rows: DataFrame, open_: DataFrame | None) -> DataFrame:
    return rows if open_ is None else rows.join(open_, "query_id", "left_semi")


def _best_of_sources(named: DataFrame, catalog, held: DataFrame, limit: int, source_id: str | None = None, page_type: str | None = None, confidence: str | None = None, each: DataFrame | None = None) -> DataFrame:
    """The best claims of the sources in named(query_id, source_id, page_id, base) with their ``bonuses``; without one a claim has the base.

    Claims at the base are in the order of their ids, so those of the first ``limit`` sources by base and smallest
    claim decide: no question meets all claims of all its sources but those that hold its terms.
    """
    named = filtered(named, catalog, source_id, page_type, each=None if each is None else each.drop("want_confidence"))
    claims = filtered(catalog.claims, catalog, confidence=confidence).select("source_id", "claim_id", "confidence_status")
    scored = filtered(named.join(held, ["source_id", "query_id"]), catalog, confidence=confidence, each=each)
    scored = scored.select("query_id", "claim_id", "source_id", "page_id", relevance(F.col("base"), F.col("bonus")).alias("raw_score"))
    if each is None:
        least = named.join(claims.groupBy("source_id").agg(F.min("claim_id").alias("least")), "source_id")
    else:
        ways = claims.select("source_id", "claim_id", F.explode(F.array("confidence_status", F.lit("any"))).alias("_way"))
        ways = ways.groupBy("source_id", "_way").agg(F.min("claim_id").alias("least"))
        wanted = each.select("query_id", F.coalesce("want_confidence", F.lit("any")).alias("_way"))
        least = named.join(wanted, "query_id").join(ways, ["source_id", "_way"]).drop("_way")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "least"))
    first = least.withColumn("place", place).filter(F.col("place") <= limit).join(claims.drop("confidence_status"), "source_id")
    first = filtered(first, catalog, each=each)
    bare = first.select("query_id", "claim_id", "source_id", "page_id", F.col("base").alias("raw_score"))
    both = ranked(scored, "raw_score", limit).drop("rank").unionByName(bare)
    return ranked(both.groupBy("query_id", "claim_id", "source_id", "page_id").agg(F.max("raw_score").alias("raw_score")), "raw_score", limit)


def alias_title(questions: DataFrame, catalog, limit: int, filters: dict | None = None, index: Index | None = None, seen: list[DataFrame] | None = None) -> DataFrame:
    """Claims of the sources behind pages that a term names: alias equal or title holding it; of a source's pages the best counts.

    With an index, titles are searched only for questions whose aliases alone don't give the best claims; without one all
    claims behind the pages are scored in one pass.
    """
    return in_blocks(_alias_title)(questions, catalog, limit, filters or {}, index, seen)


def _wanted(questions: DataFrame, filters: dict) -> DataFrame:
    """query_id, want_source, want_type, want_confidence of every question: filters that hold for all, or its own."""
    names = {"want_source": "source_id", "want_type": "page_type", "want_confidence": "confidence"}
    rows, each = questions.select("query_id"), filters.get("each")
    rows = rows if each is None else rows.join(each, "query_id", "left")
    fixed = {c: F.lit(filters.get(name) or None).cast("string") for c, name in names.items()}
    return rows.select("query_id", *[(F.coalesce(value, c) if c in rows.columns else value).alias(c) for c, value in fixed.items()])


def _behind(questions: DataFrame, catalog, limit: int, filters: dict, exact: DataFrame | None, titled: DataFrame, naming: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The best claims of the sources behind the pages in exact(page_id, term) and titled(page_id, term), and those in own(source_id, claim_id, term): see ``matching.behind``."""
    exact = titled.limit(0) if exact is None else exact
    named = exact.select("page_id", F.lit(True).alias("whole"), "term").unionByName(titled.select("page_id", F.lit(False).alias("whole"), "term"))
    named = named.groupBy("page_id").agg(F.collect_set(F.when(F.col("whole"), F.col("term"))).alias("exact"), F.collect_set(F.when(~F.col("whole"), F.col("term"))).alias("titled"))
    types = catalog.pages.groupBy("page_id").agg(F.collect_set("page_type").alias("types"))
    behind = page_sources(catalog.pages, catalog.links, catalog.relationships).join(named, "page_id").join(types, "page_id")
    pages = behind.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "types", "exact", "titled"))).alias("pages"))
    of_source = F.collect_list(F.struct("claim_id", "term")).alias("own")
    if own is None:
        pages = pages.withColumn("own", F.lit(None).cast("array<struct<claim_id: string, term: string>>")).withColumn("own_types", F.lit(None).cast("array<string>"))
    else:
        own = own.groupBy("source_id").agg(of_source).join(types.select(F.col("page_id").alias("source_id"), F.col("types").alias("own_types")), "source_id", "left")
        pages = pages.join(own, "source_id", "full")
    text = F.lower(F.concat_ws(" ", "claim_text", "citation_locator")).alias("text")
    claims = catalog.claims.select("source_id", "claim_id", "confidence_status", text)
    return ranked(matching.behind(claims, pages, asked_terms(questions, all_terms(questions)), naming, limit, _wanted(questions, filters)), "raw_score", limit)


def _alias_title(questions: DataFrame, catalog, limit: int, filters: dict, index: Index | None, seen: list[DataFrame] | None) -> DataFrame:
    weighed = keep(_weighed(questions), "asked")
    terms = keep(asked_terms(questions, listed(questions, ["catalog_terms", "text_terms"])).select("query_id", "term"), "terms")
    exact = catalog.aliases.join(F.broadcast(terms), F.col("normalized_alias") == F.col("term")).join(catalog.pages.select(F.col("page_id").alias("target_id")), "target_id")
    exact = keep(exact.select("query_id", F.col("target_id").alias("page_id"), F.lit(ALIAS).alias("base"), "term").distinct(), "pages")

    sources = page_sources(catalog.pages, catalog.links, catalog.relationships)
    best_page = [F.max("base").alias("base"), F.max_by("page_id", F.struct("base", "page_id")).alias("page_id")]

    def pages(rows: DataFrame) -> DataFrame:
        return keep(rows.groupBy("query_id", "page_id").agg(F.max("base").alias("base")), "pages")

    def units(named: DataFrame) -> Callable[[int, DataFrame | None], DataFrame]:
        """A source's page is the best of all that name it; of another type than asked for, it takes the source out."""
        kind, each = filters.get("page_type"), filters.get("each")
        wanted = named.join(catalog.pages.filter(F.col("page_type") == kind).select("page_id"), "page_id", "left_semi") if kind else named
        wanted = wanted if each is None else filtered(wanted, catalog, each=each.select("query_id", "want_type"))

        def first(size: int, open_: DataFrame | None) -> DataFrame:
            mine = _of_open(wanted, open_)
            if each is None:
                mine = mine.join(_units(wanted, catalog, index, size, filters.get("source_id")), "page_id")
            else:
                mine = _own_units(mine, catalog, index, size, each)
            window = _placed(mine.groupBy("query_id", "source_id", "slot", "least").agg(*best_page), size)
            if not kind and each is None:
                return window.withColumn("kept", F.lit(True))
            window = keep(window, "units")
            met = window.select("query_id", "source_id").distinct().join(sources, "source_id").join(named, ["query_id", "page_id"])
            met = met.groupBy("query_id", "source_id").agg(*best_page).select("query_id", "source_id", F.col("page_id").alias("best"))
            return window.join(met, ["query_id", "source_id"]).withColumn("kept", F.col("best") == F.col("page_id")).drop("best")

        return first

    def score(window: DataFrame) -> DataFrame:
        rows = filtered(window.filter("kept").join(index.texts, ["source_id", "slot"]), catalog, confidence=filters.get("confidence"), each=filters.get("each")).join(F.broadcast(weighed), "query_id")
        return rows.select("query_id", "claim_id", "source_id", "page_id", relevance(F.col("base"), matched_bonus(F.col("text"), F.col("asked"))).alias("raw_score"))

    def with_titles(open_: DataFrame) -> DataFrame:
        asking = terms.join(F.broadcast(open_), "query_id", "left_semi")
        like = holding(catalog.pages.select("page_id", F.lower("title").alias("text")), asking, "page_id").select("query_id", "page_id", F.lit(TITLE).alias("base"), "term")
        named = pages(_of_open(exact, open_).unionByName(like))
        return threshold(units(named), score, weighed.join(open_, "query_id", "left_semi"), limit, index.unit, lambda left: everything(named, left), seen=seen)

    def everything(named: DataFrame, open_: DataFrame) -> DataFrame:
        mine = _of_open(named, open_).join(sources, "page_id").groupBy("query_id", "source_id").agg(*best_page)
        return _best_of_sources(mine, catalog, bonuses(questions.join(open_, "query_id", "left_semi"), catalog.claims), limit, **filters)

    if index is None:
        titled = holding(catalog.pages.select("page_id", F.lower("title").alias("text")), terms.select("term").distinct(), "page_id")
        naming = terms.select("query_id", "term", F.lit(ALIAS).alias("base"), F.lit(TITLE).alias("titled_base"), F.lit(0.0).alias("instead"))
        best = keep(_behind(questions, catalog, limit, filters, exact.select("page_id", "term"), titled, naming), "best")
    else:
        best = keep(threshold(units(pages(exact)), score, weighed, limit, index.unit, with_titles, floor=TITLE, seen=seen), "best")
    shown = best.select("query_id", "page_id").distinct()
    titles = shown.join(catalog.pages.select("page_id", F.lower("title").alias("title")), "page_id").join(terms, "query_id").filter(F.contains("title", "term"))
    reason = shown.join(exact, ["query_id", "page_id"]).select("query_id", "page_id", F.concat(F.lit("alias_exact:"), "term").alias("reason"))
    reason = reason.unionByName(titles.select("query_id", "page_id", F.concat(F.lit("title_match:"), "term").alias("reason")))
    reasons = reason.groupBy("query_id", "page_id").agg(F.array_append(F.array_sort(F.collect_set("reason")), F.lit("page_source_claims")).alias("reasons"))
    return best.join(reasons, ["query_id", "page_id"]).withColumn("retriever", F.lit("catalog_title_alias")).select(*CANDIDATE)


def exact_span(questions: DataFrame, catalog, limit: int, filters: dict | None = None, index: Index | None = None, seen: list[DataFrame] | None = None) -> DataFrame:
    """Claims whose text, locator or source title holds a span, and claims of the sources behind pages whose title or alias does.

    Of each span the first 4 x limit claims by creation and id count, and the first 2 x limit pages by type and title.
    """
    return in_blocks(_exact_span)(questions, catalog, limit, filters or {}, index, seen)


def _exact_span(questions: DataFrame, catalog, limit: int, filters: dict, index: Index | None, seen: list[DataFrame] | None) -> DataFrame:
    weighed = keep(_weighed(questions), "asked")
    span_rows = questions.withColumn("span", F.explode(spans(questions)))
    span_rows = keep(span_rows.select("query_id", "span", F.lower("span").alias("term"), weight_of(questions, F.col("span")).alias("span_weight")), "spans")
    terms = span_rows.select("term").distinct()
    titled = catalog.claims.join(catalog.sources.select("source_id", "title"), "source_id", "left")
    text = F.lower(F.concat_ws("\n", "claim_text", "citation_locator", "title")).alias("text")
    hits = holding(titled.select("claim_id", "source_id", "created_at", text), terms, "claim_id")
    first = F.row_number().over(Window.partitionBy("term").orderBy("created_at", "claim_id"))
    of_claims = keep(hits.withColumn("place", first).filter(F.col("place") <= max(4 * limit, 20)), "spans")
    own = of_claims.join(F.broadcast(span_rows), "term")
    reason = F.concat(F.lit("exact_span:"), "span").alias("reason")
    own = keep(own.select("query_id", "source_id", "claim_id", reason, "span_weight"), "spans")
    names = catalog.pages.select("page_id", "page_type", "title", F.lower("title").alias("text"))
    aliases = catalog.aliases.select(F.col("target_id").alias("page_id"), F.explode(F.array(F.lower("alias"), F.lower("normalized_alias"))).alias("text"))
    names = names.unionByName(aliases.join(catalog.pages.select("page_id", "page_type", "title"), "page_id").select("page_id", "page_type", "title", "text"))
    pages = holding(names, terms, "page_id").select("term", "page_id", "page_type", "title").distinct()
    first = F.row_number().over(Window.partitionBy("term").orderBy("page_type", "title", "page_id"))
    of_span = keep(pages.withColumn("place", first).filter(F.col("place") <= max(2 * limit, 20)), "pages")
    pages = of_span.join(F.broadcast(span_rows), "term")
    pages = keep(pages.select("query_id", "page_id", reason, "span_weight"), "spans")
    sources = page_sources(catalog.pages, catalog.links, catalog.relationships)
    own_weight = own.groupBy("query_id", "source_id", "claim_id").agg(F.max("span_weight").alias("span_weight"))
    source_page = F.col("source_id").alias("page_id")
    columns = ["query_id", "source_id", "claim_id", "page_id", "span_weight", "place"]

    def units(size: int, open_: DataFrame | None) -> DataFrame:
        by_page = _units(pages, catalog, index, size)
        far = _of_open(pages.select("query_id", "page_id").distinct(), open_).join(by_page, "page_id").select("query_id", "source_id", "slot", "least").distinct()
        near = _of_open(own_weight, open_).select("query_id", "source_id", F.lit(None).cast("long").alias("slot"), F.col("claim_id").alias("least"))
        return _placed(far.unionByName(near).withColumn("base", F.lit(SPAN)), size)

    def merged_pages(both: DataFrame) -> DataFrame:
        order = F.struct(F.negate("raw_score"), "place", "page_id")
        best = both.groupBy("query_id", "claim_id", "source_id").agg(F.min_by("page_id", order).alias("page_id"), F.max("raw_score").alias("raw_score"))
        return filtered(best, catalog, **filters)

    def score(window: DataFrame) -> DataFrame:
        held = index.texts.select("source_id", "slot", "claim_id", "text")
        chunks = window.filter(F.col("slot").isNotNull()).select("query_id", "source_id", "slot").join(held, ["source_id", "slot"]).drop("slot")
        single = window.filter(F.col("slot").isNull()).select("query_id", "source_id", F.col("least").alias("claim_id")).join(held.drop("slot"), ["source_id", "claim_id"])
        rows = chunks.unionByName(single, allowMissingColumns=True).dropDuplicates(["query_id", "claim_id"]).join(F.broadcast(weighed), "query_id")
        rows = keep(rows.select("query_id", "source_id", "claim_id", _bonus(F.col("text"), F.col("asked")).alias("bonus")), "bonuses")
        mine = rows.join(own_weight, ["query_id", "source_id", "claim_id"]).withColumn("page_id", F.col("source_id")).withColumn("place", F.lit(0))
        wanted = rows.select("query_id", "source_id").distinct().join(sources, "source_id").join(pages, ["query_id", "page_id"])
        wanted = wanted.groupBy("query_id", "source_id").agg(F.max("page_id").alias("page_id"), F.max("span_weight").alias("span_weight"))
        far = rows.join(wanted, ["query_id", "source_id"]).withColumn("place", F.lit(1))
        both = mine.select(*columns, "bonus").unionByName(far.select(*columns, "bonus"))
        return merged_pages(both.withColumn("raw_score", relevance(SPAN, F.coalesce("bonus", "span_weight"))))

    def everything(open_: DataFrame) -> DataFrame:
        held = bonuses(questions.join(open_, "query_id", "left_semi"), catalog.claims)
        far = _of_open(pages, open_).join(sources, "page_id").groupBy("query_id", "source_id").agg(F.max("page_id").alias("page_id"), F.max("span_weight").alias("span_weight"))
        far = far.join(catalog.claims.select("source_id", "claim_id"), "source_id").withColumn("place", F.lit(1))
        both = _of_open(own_weight, open_).select("query_id", "source_id", "claim_id", source_page, "span_weight", F.lit(0).alias("place")).unionByName(far.select(*columns))
        both = both.join(held, ["source_id", "claim_id", "query_id"], "left")
        return ranked(merged_pages(both.withColumn("raw_score", relevance(SPAN, F.coalesce("bonus", "span_weight")))), "raw_score", limit)

    if index is None:
        naming = span_rows.groupBy("query_id", "term").agg(F.max("span_weight").alias("instead"))
        naming = naming.select("query_id", "term", F.lit(SPAN).alias("base"), F.lit(SPAN).alias("titled_base"), "instead")
        best = keep(_behind(questions, catalog, limit, filters, None, of_span.select("page_id", "term"), naming, of_claims.select("source_id", "claim_id", "term")), "best")
    else:
        best = keep(threshold(units, score, weighed, limit, index.unit, everything, seen=seen), "best")
    collected = F.array_sort(F.collect_set("reason"))
    by_claim = own.groupBy("query_id", "claim_id").agg(collected.alias("by_claim"))
    behind = best.select("query_id", "source_id").distinct().join(sources.withColumnRenamed("page_id", "via"), "source_id").join(pages.withColumnRenamed("page_id", "via"), ["query_id", "via"])
    by_source = behind.groupBy("query_id", "source_id").agg(F.array_append(collected, F.lit("page_source_claims")).alias("by_source"))
    best = best.join(by_claim, ["query_id", "claim_id"], "left").join(by_source, ["query_id", "source_id"], "left")
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat(F.coalesce("by_claim", none), F.coalesce("by_source", none))).alias("reasons")
    return best.select("query_id", "claim_id", "source_id", "page_id", "raw_score", reasons, F.lit("exact_formula_symbol").alias("retriever"))


def graph(seeds: DataFrame, catalog, limit: int, pool: int = 80, filters: dict | None = None) -> DataFrame:
    """Claims of sources one relationship away from the seeds (query_id, claim_id, source_id, page_id), seeds left out.

    All have one score, so ids decide: of a key's claims that pass the filters only the first ``limit`` beside ``pool``
    seeds can be among a question's first.  A key that names a third of the sources therefore costs no more than another.
    """
    fixed = {k: v for k, v in (filters or {}).items() if k != "each"}
    relationships, claims = catalog.relationships, filtered(catalog.claims.withColumn("page_id", F.col("source_id")), catalog, **fixed)
    keys = seeds.select("query_id", F.explode(F.array("claim_id", "source_id", "page_id")).alias("key")).distinct()
    sides = relationships.select(F.explode(F.array_distinct(F.array_compact(F.array("subject_id", "object_id", "evidence_claim_id", "source_id")))).alias("key"), F.array_compact(F.array("subject_id", "object_id", "source_id")).alias("nodes"))
    near = sides.join(keys.select("key").distinct(), "key", "left_semi").select("key", F.explode("nodes").alias("source_id")).filter(F.col("source_id").startswith("src_")).distinct()
    near = near.join(claims.select("claim_id", "source_id"), "source_id")
    first, keys = _first_passing(near, keys, "key", limit + pool, catalog, (filters or {}).get("each"))
    found = keys.join(first, "_of").select("query_id", "claim_id", "source_id").distinct().join(seeds.select("query_id", "claim_id"), ["query_id", "claim_id"], "left_anti")
    rows = found.select("query_id", "claim_id", "source_id", F.col("source_id").alias("page_id"), F.lit(RELATED).alias("raw_score"), F.array(F.lit("graph_relationship")).alias("reasons"), F.lit("graph").alias("retriever"))
    return ranked(rows, "raw_score", limit).drop("rank")


def cosine(a: Column, b: Column) -> Column:
    """0.0 for other lengths, empty and zero vectors."""
    dot = F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(dot, F.lit(0.0))).otherwise(0.0)


def unit(v: Column) -> Column:
    """The vector of length 1; null for empty and zero vectors."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.when(square > 0, F.transform(F.array(F.sqrt(square)), lambda n: F.transform(v, lambda x: x / n))[0])


@in_blocks
def vector(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, score, rank of the chunks with positive cosine.  Queries (query_id, query_vector) are broadcast.

    Empty, zero and vectors of another length have no cosine.  Each vector is brought to length 1 once, and each task
    hands on the best rows of a query alone.
    """
    return ranked(vectors.nearest(queries, chunks, limit), "score", limit, tie="chunk_id")


def vector_stages(queries: DataFrame, indexes: DataFrame) -> DataFrame:
    """Queries (query_id, index_id, query_vector, error) with the stage at which each fails, null if it can be searched, and a warning.

    indexes(index_id, enabled, present, error, dimension) say what is known of each index; a query of an unknown one has
    no index.  The first stage that applies counts, in the order of a search.  A null vector is an empty one.
    """
    known = indexes.select("index_id", F.coalesce("enabled", F.lit(False)).alias("_enabled"), F.coalesce("present", F.lit(False)).alias("_present"), F.col("error").alias("_load"), "dimension")
    rows = queries.join(known, "index_id", "left")
    size = F.coalesce(F.size("query_vector"), F.lit(0))
    stages = {
        "disabled": ~F.col("_enabled"), "missing_index": ~F.coalesce("_present", F.lit(False)), "index_load_failed": F.col("_load").isNotNull(), "query_embedding_failed": F.col("error").isNotNull(),
        "empty_query_vector": size <= 0, "query_dimension_mismatch": ~size.eqNullSafe(F.col("dimension")),
    }
    stage = F.coalesce(*[F.when(holds, name) for name, holds in stages.items()])
    said = F.when(stage == "index_load_failed", F.col("_load")).when(stage == "query_embedding_failed", F.col("error")).when(stage == "query_dimension_mismatch", "dimensions of query and index differ")
    return rows.select(*queries.columns, stage.alias("failure_stage"), said.alias("warning"))


def vector_candidates(hits: DataFrame, catalog, limit: int, filters: dict | None = None) -> DataFrame:
    """Candidates of chunk hits (query_id, chunk_id, score): a claim by its own score, the claims behind a title by 0.8 of its.

    Chunk ids are those of ``ingest.chunks``; hits whose claim, page or source is not in the catalog lead nowhere.
    Ties between hits of one claim go to the claim's own chunk, then to its source's title.
    """
    kind, key = F.substring_index("chunk_id", ":", 1), F.expr("substring(chunk_id, instr(chunk_id, ':') + 1)")
    rows = hits.select("query_id", kind.alias("kind"), key.alias("key"), "score")
    fixed, each = {k: v for k, v in (filters or {}).items() if k != "each"}, (filters or {}).get("each")
    claims = filtered(catalog.claims.withColumn("page_id", F.col("source_id")), catalog, **fixed).select("claim_id", "source_id")
    own = rows.filter(F.col("kind") == "claim").select("query_id", F.col("key").alias("claim_id"), F.round("score", 6).alias("raw_score"), F.lit("claim").alias("kind")).join(claims, "claim_id")
    own = filtered(own.withColumn("page_id", F.col("source_id")), catalog, each=each).select("query_id", "claim_id", "raw_score", "kind", "source_id")
    pages = page_sources(catalog.pages, catalog.links, catalog.relationships).select(F.lit("page_title").alias("kind"), F.col("page_id").alias("key"), "source_id")
    behind = pages.unionByName(catalog.sources.select(F.lit("source_title").alias("kind"), F.col("source_id").alias("key"), "source_id"))
    behind = behind.join(rows.select("kind", "key").distinct(), ["kind", "key"], "left_semi").withColumn("of", F.concat_ws(":", "kind", "key"))
    titles = rows.filter(F.col("kind") != "claim").withColumn("of", F.concat_ws(":", "kind", "key"))
    first, titles = _first_passing(behind.join(claims, "source_id").select("of", "claim_id", "source_id"), titles, "of", limit, catalog, each)
    titled = titles.join(first, "_of").select("query_id", "claim_id", "source_id", F.round(F.lit(0.8) * F.col("score"), 6).alias("raw_score"), "kind")
    best = own.unionByName(titled).groupBy("query_id", "claim_id", "source_id").agg(F.max("raw_score").alias("raw_score"), F.max_by("kind", F.struct("raw_score", (F.col("kind") == "claim").alias("own"), "kind")).alias("kind"))
    reasons = F.when(F.col("kind") == "claim", F.array(F.lit("vector_semantic"))).otherwise(F.array(F.lit("vector_semantic"), F.concat(F.lit("vector_chunk:"), "kind")))
    out = best.select("query_id", "claim_id", "source_id", F.col("source_id").alias("page_id"), "raw_score", reasons.alias("reasons"), F.lit("vector").alias("retriever"))
    return ranked(out, "raw_score", limit).drop("rank")


def diagnostics(lists: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """query_id, step, candidates: how many each retriever found, all of them together, and what fusion made of them."""
    rows = None
    for df in lists:
        part = df.select("query_id", F.col("retriever").alias("step"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.unionByName(rows.withColumn("step", F.lit("before fusion"))).unionByName(seeds.select("query_id", F.lit("after fusion").alias("step")))
    return rows.groupBy("query_id", "step").agg(F.count("*").alias("candidates"))


def fused(lists: list[DataFrame], limit: int | None) -> DataFrame:
    """Reciprocal rank fusion of candidate lists: the sum of 1 / (60 + rank), the best raw score's page, all provenance."""
    rows = None
    for place, df in enumerate(lists):
        part = df.select(*CANDIDATE).withColumn("place", F.lit(place))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "place").orderBy(F.desc("raw_score"), "claim_id")))
    order = F.array_sort(F.collect_list(F.struct("place", "retriever", "reasons")))
    grouped = rows.groupBy("query_id", "claim_id", "source_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("rrf"),
        F.max_by(F.struct("page_id", "raw_score"), F.struct("raw_score", F.negate("place"))).alias("best"),
        order.alias("parts"),
    )
    flat = grouped.select(
        "query_id", "claim_id", "source_id", "best.page_id", "best.raw_score", "rrf",
        F.array_distinct(F.transform("parts", lambda p: p["retriever"])).alias("retrievers"), F.array_distinct(F.flatten(F.transform("parts", lambda p: p["reasons"]))).alias("reasons"),
    )
    return ranked(flat, "rrf", limit, name="retriever_rank")


def hybrid(questions: DataFrame, catalog, limit: int, pool: int = 80, vectors: DataFrame | None = None, filters: dict | None = None, lists: list[DataFrame] | None = None, index: Index | None = None) -> DataFrame:
    """Lexical and vector lists fused to seeds, one graph step, all lists fused again, claims attached.

    ``vectors`` are hits on chunks (query_id, chunk_id, score).  ``filters`` are arguments of ``filtered``: each list
    is filtered after its fetch limit and before its own.  ``lists`` are those of ``lexical`` with the same filters.
    """
    lists = lexical(questions, catalog, pool, filters, index=index) if lists is None else list(lists)
    if vectors is not None:
        lists.append(keep(vector_candidates(ranked(vectors, "score", max(8 * pool, 20), tie="chunk_id"), catalog, pool, filters).select(*CANDIDATE), "candidates"))
    seeds = keep(fused(lists, None), "seeds")
    lists.append(graph(seeds, catalog, pool, len(lists) * pool, filters))
    return keep(with_claims(fused(lists, limit), catalog.claims), "pool")


def lexical(questions: DataFrame, catalog, pool: int, filters: dict | None = None, found: DataFrame | None = None, index: Index | None = None) -> list[DataFrame]:
    """Candidates by text, by alias or title, and by exact span, each kept: they are fused twice.  ``found`` may hold the BM25 hits."""
    fetch = max(8 * pool, 20)
    text = merged(full_text(questions, catalog.claims, fetch, found, index), substring(questions, catalog.claims, fetch, index)).withColumn("retriever", F.lit("bm25_fts"))
    text = ranked(filtered(text, catalog, **(filters or {})), "raw_score", pool)
    lists = [text, alias_title(questions, catalog, pool, filters, index), exact_span(questions, catalog, pool, filters, index)]
    return [keep(x.select(*CANDIDATE), "candidates") for x in lists]


def _first_passing(claims: DataFrame, asking: DataFrame, key: str, limit: int, catalog, each: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The first claims by id of each key that pass the filters of those who ask for it, and ``asking``, both with _of, which joins them.

    Questions with equal filters share a key's claims; a key that leads to a third of them is cut for each set of filters.
    """
    if each is None:
        first = first_by_id(claims, key, limit).withColumnRenamed(key, "_of").select("_of", "claim_id", "source_id")
        return first, asking.withColumn("_of", F.col(key))
    wants = [c for c in ("want_source", "want_type", "want_confidence") if c in each.columns]
    named = F.to_json(F.struct(F.col(key).alias("key"), *wants)).alias("_of")
    asking = asking.join(each, "query_id", "left").withColumn("_of", named)
    sets = asking.select(key, "_of", *wants).distinct()
    rows = claims.join(sets, key).withColumn("page_id", F.col("source_id"))
    first = first_by_id(_passing(rows, catalog), "_of", limit)
    return first.select("_of", "claim_id", "source_id"), asking.drop(*wants)


def _passing(rows: DataFrame, catalog) -> DataFrame:
    """Rows that pass the filters which stand beside them (want_source, want_type, want_confidence), null for any."""
    if "want_source" in rows.columns:
        rows = rows.filter(F.col("want_source").isNull() | (F.col("want_source") == F.col("source_id"))).drop("want_source")
    if "want_type" in rows.columns:
        kinds = catalog.pages.select("page_id", F.col("page_type").alias("want_type"), F.lit(True).alias("_passes")).distinct()
        rows = rows.join(kinds, ["page_id", "want_type"], "left").filter(F.col("want_type").isNull() | F.col("_passes")).drop("want_type", "_passes")
    if "want_confidence" in rows.columns:
        kinds = catalog.claims.select("claim_id", F.col("confidence_status").alias("want_confidence"), F.lit(True).alias("_passes")).distinct()
        rows = rows.join(kinds, ["claim_id", "want_confidence"], "left").filter(F.col("want_confidence").isNull() | F.col("_passes")).drop("want_confidence", "_passes")
    return rows


def filters_of(wanted: DataFrame) -> DataFrame:
    """Filters (query_id, source_id, page_type, confidence) of each question as ``each`` of ``filtered`` takes them; empty ones do not count."""
    given = lambda c, name: F.when(F.col(c) != "", F.col(c)).alias(name)
    return wanted.select("query_id", given("source_id", "want_source"), given("page_type", "want_type"), given("confidence", "want_confidence")).dropDuplicates(["query_id"])


def filtered(rows: DataFrame, catalog, source_id: str | None = None, page_type: str | None = None, confidence: str | None = None, each: DataFrame | None = None) -> DataFrame:
    """Rows with claim_id, source_id and page_id that pass the filters that are given; empty ones do not count.

    ``each`` holds filters of every question (``filters_of``), so that a batch of questions may differ in them.
    """
    rows = rows.filter(F.col("source_id") == source_id) if source_id else rows
    if page_type:
        rows = rows.join(catalog.pages.filter(F.col("page_type") == page_type).select("page_id"), "page_id", "left_semi")
    if confidence:
        rows = rows.join(catalog.claims.filter(F.col("confidence_status") == confidence).select("claim_id"), "claim_id", "left_semi")
    return rows if each is None else _passing(rows.join(each, "query_id", "left"), catalog)
