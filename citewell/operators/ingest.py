"""Knowledge pages from sources: concepts, patches, chunks, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Aliases of concepts by subject, and the one entity that claims are searched for.
ALIASES = {"rag": ("RAG", "retrieval augmented generation"), "alias": ("alias", "identity resolution"), "conflict": ("conflict", "contradiction")}
ENTITY = ("OpenAI", "Open AI", "Open-AI")


def concise(title: Column, source_title: Column) -> Column:
    """A title; if it is the source's own, what stands there before a colon, a full-width one first."""
    before = lambda mark: T.strip(F.regexp_extract(source_title, f"^([^{mark}]*){mark}", 1))
    prefix = F.when(before("：") != "", before("：")).otherwise(before(":"))
    return F.when((T.normalize_alias(title) == T.normalize_alias(source_title)) & (prefix != ""), prefix).otherwise(title)


def cleaned_aliases(title: Column, aliases: Column, source_title: Column) -> Column:
    """The title and its aliases, each key once, without blank ones and the source's title; the title if nothing is left."""
    listed = F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")))
    keys = F.transform(listed, T.normalize_alias)
    kept = F.filter(listed, lambda x, i: (F.array_position(keys, T.normalize_alias(x)) == i + 1) & ~T.normalize_alias(x).isin("") & (T.normalize_alias(x) != T.normalize_alias(source_title)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(title))


def concept_titles(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """source_id, concept_title, concept_aliases: by fixed subjects that the claims name, else the cleaned title, cut at a colon."""
    low = F.lower("claim_text")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    words = F.array_join(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), " ")
    subject = claims.groupBy("source_id").agg(
        flag(words.rlike(r"\brag\b") | F.contains(words, F.lit("retrieval augmented generation"))).alias("rag"),
        flag(low.rlike(r"\balias\b")).alias("alias"), flag(low.rlike(r"\bconflict|contradict")).alias("conflict"),
    )
    cleaned = T.strip(F.regexp_replace("title", r"(?i)\b(notes|source|overview)\b", ""))
    short = concise(F.when(cleaned == "", F.col("title")).otherwise(cleaned), F.col("title"))
    name = F.when(F.col("rag") == 1, "Retrieval Augmented Generation").when(F.col("alias") == 1, "Alias Resolution").when(F.col("conflict") == 1, "Conflict Preservation").otherwise(short)
    known = lambda kind: F.array(*map(F.lit, ALIASES[kind]))
    aliases = F.when(F.col("rag") == 1, known("rag")).when(F.col("alias") == 1, known("alias")).when(F.col("conflict") == 1, known("conflict")).otherwise(F.array(short))
    rows = sources.select("source_id", "title").join(subject, "source_id", "left")
    return rows.select("source_id", name.alias("concept_title"), aliases.alias("concept_aliases"))


def entities(claims: DataFrame) -> DataFrame:
    """source_id, entity_title, entity_aliases of sources whose claims (source_id, line, claim_text), read as one text, name the entity.

    Only letters and digits count, so the name may reach over claims: each is read with the end of the ones before it.
    """
    compact = F.array_join(F.regexp_extract_all(F.lower("claim_text"), F.lit("[a-z0-9]+"), F.lit(0)), "")
    rows = claims.select("source_id", "line", compact.alias("compact")).filter(F.col("compact") != "")
    key, short = ENTITY[0].lower(), len(ENTITY[0]) - 1
    before = F.collect_list(F.substring("compact", -short, short)).over(Window.partitionBy("source_id").orderBy("line").rowsBetween(-short, -1))
    named = rows.withColumn("text", F.concat(F.substring(F.array_join(before, ""), -short, short), "compact")).filter(F.contains("text", F.lit(key)))
    return named.select("source_id").distinct().select("source_id", F.lit(ENTITY[0]).alias("entity_title"), F.array(*map(F.lit, ENTITY)).alias("entity_aliases"))


def proposed(proposals: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """source_id, concept_title, concept_aliases, entity_title, entity_aliases of every source: of its proposal, else inferred.

    Proposals have these columns, at most one row for a source; null and empty titles and lists propose nothing.
    """
    p = proposals.select("source_id", *[F.col(c).alias(f"p_{c}") for c in ("concept_title", "concept_aliases", "entity_title", "entity_aliases")])
    rows = sources.select("source_id", "title").join(concept_titles(sources, claims), "source_id").join(entities(claims), "source_id", "left").join(p, "source_id", "left")
    given = lambda c: F.coalesce(F.col(f"p_{c}") != "", F.lit(False))
    some = lambda c, other: F.when(F.coalesce(F.size(f"p_{c}"), F.lit(0)) > 0, F.col(f"p_{c}")).otherwise(other)
    title = concise(F.col("p_concept_title"), F.col("title"))
    aliases = cleaned_aliases(title, some("concept_aliases", F.col("concept_aliases")), F.col("title"))
    return rows.select(
        "source_id",
        F.when(given("concept_title"), title).otherwise(F.col("concept_title")).alias("concept_title"),
        F.when(given("concept_title"), aliases).otherwise(F.col("concept_aliases")).alias("concept_aliases"),
        F.when(given("entity_title"), F.col("p_entity_title")).otherwise(F.col("entity_title")).alias("entity_title"),
        F.when(given("entity_title"), some("entity_aliases", F.array("p_entity_title"))).otherwise(F.col("entity_aliases")).alias("entity_aliases"),
    )


def alias_targets(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """alias, target: the path of the page that an alias names, else its type and id."""
    known = pages.select(F.col("page_id").alias("target_id"), "path")
    return aliases.join(known, "target_id", "left").select("alias", F.coalesce("path", F.concat_ws(":", "target_type", "target_id")).alias("target"))


def formal(claims: DataFrame) -> DataFrame:
    return claims.filter((F.coalesce("citation_locator", F.lit("")) != "") & ~F.col("confidence_status").isin("weak", "uncited"))


def patches(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Two page patches for each source, its own page and its concept's, with their links and claim ids."""
    ids = formal(claims).groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "claim_id"))), lambda x: x["claim_id"]).alias("claim_ids"))
    rows = sources.select("source_id", "title").join(concept_titles(sources, claims), "source_id").join(ids, "source_id", "left")
    rows = rows.withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>"))).withColumn("concept_id", F.concat(F.lit("concept:"), T.slugify(F.col("concept_title"))))
    patch = lambda page, kind, title, path, link, to: F.struct(page.alias("page_id"), F.lit(kind).alias("page_type"), title.alias("title"), path.alias("target_path"), F.lit(link).alias("link_type"), to.alias("link_to"))
    both = F.array(
        patch(F.col("source_id"), "source", F.col("title"), F.concat(F.lit("wiki/sources/"), "source_id", F.lit(".md")), "mentions", F.col("concept_id")),
        patch(F.col("concept_id"), "concept", F.col("concept_title"), F.concat(F.lit("wiki/concepts/"), T.slugify(F.col("concept_title")), F.lit(".md")), "supports", F.col("source_id")),
    )
    return rows.select("source_id", "claim_ids", F.explode(both).alias("p")).select("source_id", "p.*", F.size("claim_ids").cast("long").alias("n_claims"), F.array_join("claim_ids", ",").alias("claim_ids"))


def rendered(patched: DataFrame, claims: DataFrame) -> DataFrame:
    """page_type, page_id, content: front matter, title and one bullet for each formal claim of a source page."""
    bullet = F.concat(F.lit("- "), "claim_text", F.lit(" ["), "claim_id", F.lit("; "), "citation_locator", F.lit("]"))
    bullets = formal(claims).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", bullet.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    page = patched.filter(F.col("page_type") == "source").join(bullets, "source_id", "left")
    content = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("page_id: "), "page_id"), F.concat(F.lit("title: "), T.yaml_quote(F.col("title"))), F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), F.lit("## Claims"), F.coalesce("body", F.lit("")))
    return page.select("page_type", "page_id", content.alias("content"))


def chunks(claims: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk_id, chunk_type, text of everything that is embedded: claims, page titles with aliases, source titles."""
    return (
        claims.select(F.concat(F.lit("claim:"), "claim_id").alias("chunk_id"), F.lit("claim").alias("chunk_type"), F.col("claim_text").alias("text"))
        .unionByName(pages.select(F.concat(F.lit("page_title:"), "page_id").alias("chunk_id"), F.lit("page_title").alias("chunk_type"), F.concat_ws(" ", "title", F.array_join(F.from_json("aliases", "array<string>"), " ")).alias("text")))
        .unionByName(sources.select(F.concat(F.lit("source_title:"), "source_id").alias("chunk_id"), F.lit("source_title").alias("chunk_type"), F.col("title").alias("text")))
    )


def review(claims: DataFrame) -> DataFrame:
    """source_id, claims, weak, coverage (percent with citation, halves to even)."""
    cited = F.when(F.col("confidence_status") == "cited", 1.0).otherwise(0.0)
    return claims.groupBy("source_id").agg(F.count("*").alias("claims"), F.sum(F.when(F.col("confidence_status") == "cited", 0).otherwise(1)).alias("weak"), F.bround(100 * F.avg(cited)).cast("long").alias("coverage"))


def numbered_proposal(proposals: DataFrame) -> DataFrame:
    """Claims of proposals (source_id, claims array of struct text, locator, confidence): ids by place, blanks use one up."""
    rows = proposals.select("source_id", F.posexplode("claims").alias("pos", "c")).filter(T.strip(F.col("c.text")) != "")
    number = F.format_string("%03d", F.col("pos") + 1)
    return rows.select(F.concat(F.lit("clm_"), "source_id", F.lit("_llm_"), number).alias("claim_id"), "source_id", T.strip(F.col("c.text")).alias("claim_text"), F.col("c.locator").alias("citation_locator"), T.confidence(F.col("c.locator"), F.col("c.confidence")).alias("confidence_status"))
