"""Checks of a catalog: what is broken, orphaned, ambiguous, uncited or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .upsert import page_references


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    return links.join(page_references(pages).select(F.col("ref").alias("to_page")), "to_page", "left_anti").select("from_page", "to_page", "link_type")


def orphan_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that are no end of any link that resolves."""
    ends = links.select(F.explode(F.array("from_page", "to_page")).alias("ref")).distinct()
    linked = ends.join(page_references(pages), "ref").select("page_id").distinct()
    return pages.filter(F.col("page_type") != "index").join(linked, "page_id", "left_anti").select("page_id", "path")


def ambiguous_aliases(aliases: DataFrame) -> DataFrame:
    """normalized_alias, targets, shared: aliases of more than one target; shared ones name one concept and entity."""
    targets = aliases.select("normalized_alias", "target_type", "target_id").distinct()
    name = F.when(F.contains("target_id", F.lit(":")), F.substring_index("target_id", ":", -1)).otherwise(F.col("target_id"))
    grouped = targets.groupBy("normalized_alias").agg(F.count("*").alias("targets"), F.array_sort(F.collect_set("target_type")).alias("types"), F.countDistinct(name).alias("names"))
    shared = (F.array_join("types", ",") == "concept,entity") & (F.col("names") == 1)
    return grouped.filter(F.col("targets") > 1).select("normalized_alias", "targets", shared.alias("shared"))


def uncited_evidence(claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """Claims without a locator that a relationship rests on."""
    used = relationships.select(F.col("evidence_claim_id").alias("claim_id")).distinct()
    return claims.filter(F.coalesce("citation_locator", F.lit("")) == "").join(used, "claim_id", "left_semi").select("claim_id")


def uncited_with_locator(claims: DataFrame) -> DataFrame:
    return claims.filter((F.coalesce("citation_locator", F.lit("")) != "") & F.col("confidence_status").isin("weak", "uncited")).select("claim_id", "confidence_status")


def hash_drift(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Sources whose content (source_id, text) is gone or no longer has the recorded hash."""
    now = contents.select("source_id", F.sha2("text", 256).alias("now"))
    return sources.select("source_id", "sha256").join(now, "source_id", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("source_id", F.col("now").isNull().alias("missing"))


def fingerprint(relation: DataFrame, columns: list[str]) -> DataFrame:
    """rows, fingerprint of a relation: row hashes are summed in parts, so order and partitions do not matter."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"p{i}")
    summed = relation.agg(F.count("*").alias("rows"), *[part(i) for i in range(4)])
    return summed.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0)) for i in range(4)]), 256).alias("fingerprint"))


def report(catalog, contents: DataFrame) -> DataFrame:
    """check, found, issue: one row for each check; informational ones are no issues."""
    a = ambiguous_aliases(catalog.aliases)
    counts = [
        ("broken links", broken_links(catalog.links, catalog.pages), True), ("orphan pages", orphan_pages(catalog.links, catalog.pages), True),
        ("duplicate alias", a.filter(~F.col("shared")), True), ("shared concept/entity alias", a.filter("shared"), False),
        ("uncited claims", uncited_evidence(catalog.claims, catalog.relationships), True), ("uncited with locator", uncited_with_locator(catalog.claims), False),
        ("source hash drift", hash_drift(catalog.sources, contents), True), ("recorded contradicts relationships", catalog.relationships.filter(F.col("relationship_type") == "contradicts"), False),
    ]
    rows = [df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found", F.lit(issue).alias("issue")) for name, df, issue in counts]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def title_prefixes(titles: DataFrame, counts: DataFrame) -> DataFrame:
    """id, tokens (rarest first by counts(token, titles)), token of titles(id, title): one row for each token that can be a pair's first common one.

    Similar titles share two words at least, so a pair's first common word is never the last of either: the commonest
    word of a title leads to no candidates, however many titles hold it.
    """
    words = titles.select("id", F.explode(T.title_tokens(F.col("title"))).alias("token")).join(counts, "token")
    ordered = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("titles", "token"))), lambda x: x["token"]).alias("tokens"))
    return ordered.select("id", "tokens", F.explode(F.slice("tokens", 1, F.size("tokens") - 1)).alias("token"))


def similar_titles(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted_id, page_id of titles that share two words and half of the shorter one's: an overlap join with a prefix filter.

    A pair that shares t words meets at its first common word in rarest-first order, which has t - 1 more behind it in
    both titles, and at that word alone.  So a pair comes out once, and pairs that share frequent words only are tested
    only where their titles are short enough for these to do.  Titles without words are similar to nothing.
    """
    both = pages.select(F.col("page_id").alias("id"), "title").unionByName(wanted.select(F.col("wanted_id").alias("id"), "title"))
    counts = both.select(F.explode(T.title_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("titles"))
    side = lambda df, id_, tokens: title_prefixes(df.select(F.col(id_).alias("id"), "title").distinct(), counts).select(F.col("id").alias(id_), F.col("tokens").alias(tokens), "token")
    a, b = side(wanted, "wanted_id", "a"), side(pages, "page_id", "b")
    need = lambda n, m: F.greatest(F.lit(2), F.ceil(F.least(n, m) / 2))
    behind = lambda tokens: F.size(tokens) - F.array_position(tokens, F.col("token")) + 1
    least = need(F.size("a"), F.size("b"))
    pairs = a.join(b, "token").filter((behind("a") >= least) & (behind("b") >= least))
    shared = F.array_intersect("a", "b")
    return pairs.filter((F.size(shared) >= least) & (F.get(shared, F.lit(0)) == F.col("token"))).select("wanted_id", "page_id")


def same_titles(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted_id, page_id, how: pages that share a key with a wanted title(wanted_id, title), or most of its words.

    Keys and rare words are joined, never page with page; a pair that shares a key is not also called similar.
    """
    key = lambda df, name: df.select(F.col(name), F.explode(T.alias_keys(F.col("title"))).alias("key"))
    matching = key(wanted, "wanted_id").join(key(pages, "page_id"), "key").select("wanted_id", "page_id").distinct()
    similar = similar_titles(pages, wanted).join(matching, ["wanted_id", "page_id"], "left_anti")
    return matching.withColumn("how", F.lit("matching")).unionByName(similar.withColumn("how", F.lit("similar")))
