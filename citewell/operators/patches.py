"""Page patches: what their heads say, and everything that speaks against applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a page's head and body must have.
FIELDS = ("aliases", "claim_ids", "page_type", "source_count", "title", "updated_at")
LISTS = ("aliases", "claim_ids")
PAGE_SECTIONS = {
    "source": ("Source Metadata", "Key Claims", "Summary", "Important Evidence", "Possible Conflicts", "Links"),
    "concept": ("Definition", "Key Claims", "Related Concepts", "Supporting Sources", "Open Questions"),
    "entity": ("Overview", "Aliases", "Key Claims", "Relationships", "Supporting Sources", "Open Questions"),
    "synthesis": ("Question/Topic", "Short Answer", "Evidence", "Analysis", "Uncertainties", "Related Pages"),
}
#: An item of a list literal: a quoted string, a number, or a named constant.
_ITEM = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[+-]?\d+(?:\.\d+)?|True|False|None)"""
_LIST = rf"\A\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?\]\z"
_FAULT = "array<string>"


def unquoted(value: Column) -> Column:
    """A value without the quotes around it, if both are alike."""
    return F.when(value.rlike(r"""(?s)\A(?:'.*'|".*")\z""") & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def list_value(value: Column) -> Column:
    """The items of a list literal of plain values, null if it is none; escapes stand for the character after them."""
    items = F.regexp_extract_all(value, F.lit(_ITEM), F.lit(0))
    return F.when(value.rlike(_LIST), F.transform(items, lambda x: F.regexp_replace(unquoted(x), r"\\(.)", "$1")))


def head(content: Column) -> Column:
    """What the lines between the first two --- lines say: state, fields (key, value; a later one replaces), and lines without a colon.

    The state is null for a whole head, else "missing" or "not closed".  Lines are folded one after another; blank ones
    do not count.  Null content has no head.
    """
    lines = F.split(F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n"), "\n")
    start = F.struct(F.lit("before").alias("at"), F.array().cast("array<struct<key:string,value:string>>").alias("fields"), F.array().cast(_FAULT).alias("odd"))

    def step(s: Column, line: Column) -> Column:
        bare = T.strip(line)
        mark, colon = bare == "---", F.instr(line, ":")
        at = F.when(s["at"] == "before", F.when(mark, "inside").otherwise("missing")).when((s["at"] == "inside") & mark, "closed").otherwise(s["at"])
        field = F.struct(T.strip(F.substring(line, F.lit(1), colon - 1)).alias("key"), unquoted(T.strip(F.substring(line, colon + 1, F.length(line)))).alias("value"))
        told = (s["at"] == "inside") & ~mark & (bare != "")
        fields = F.when(told & (colon > 0), F.array_append(F.filter(s["fields"], lambda x: x["key"] != field["key"]), field)).otherwise(s["fields"])
        return F.struct(at.alias("at"), fields.alias("fields"), F.when(told & (colon == 0), F.array_append(s["odd"], line)).otherwise(s["odd"]).alias("odd"))

    done = F.aggregate(lines, start, step)
    state = lambda s: F.when(s["at"].isin("before", "missing"), "missing").when(s["at"] == "inside", "not closed")
    return F.transform(F.array(done), lambda s: F.struct(state(s).alias("state"), s["fields"].alias("fields"), s["odd"].alias("odd")))[0]


def _value(read: Column, key: str) -> Column:
    return F.get(F.filter(read["fields"], lambda x: x["key"] == key), F.lit(0))["value"]


def patch_faults(patches: DataFrame, claims: DataFrame) -> DataFrame:
    """page_id, fault: all that is wrong with patches (page_id, action, page_type, target_path, content, claim_ids), not the first alone.

    A patch upserts a Markdown page below wiki/, not the log; its head is closed, has all fields, lists where lists
    belong and the patch's own page type; its claims are known, cited and one at least; its page has all sections of its
    type.  Faults of a head that cannot be read leave out those that depend on it.  Nulls count as missing.
    """
    rows = patches.withColumn("read", head(F.col("content")))
    path, read, kind = F.coalesce("target_path", F.lit("")), F.col("read"), _value(F.col("read"), "page_type")
    parts = F.split(path, "/")
    one = lambda flag, name: F.when(flag, F.array(F.lit(name) if isinstance(name, str) else name)).otherwise(F.array().cast(_FAULT))
    whole = read["state"].isNull()
    keys = F.transform(read["fields"], lambda x: x["key"])
    missing = F.transform(F.array_except(F.array(*[F.lit(c) for c in FIELDS]), keys), lambda c: F.concat(F.lit("no field "), c))
    lists = [one(whole & F.array_contains(keys, c) & list_value(_value(read, c)).isNull(), f"{c} is no list") for c in LISTS]
    wanted = F.array().cast(_FAULT)
    for name, sections in PAGE_SECTIONS.items():
        lacking = F.array_compact(F.array(*[F.when(~F.coalesce("content", F.lit("")).rlike(rf"(?m)^##\s+{s}\s*$"), f"no section {s}") for s in sections]))
        wanted = F.when(kind == name, lacking).otherwise(wanted)
    faults = F.concat(
        one(~F.coalesce(F.col("action") == "upsert_page", F.lit(False)), "unknown action"),
        one(path == "", "no target"),
        one((path != "") & (path.startswith("/") | F.array_contains(parts, "..") | ~path.rlike(r"\Awiki/.")), "target outside wiki"),
        one(path == "wiki/log.md", "target is the log"),
        one((path != "") & ~F.lower(path).endswith(".md"), "target is not Markdown"),
        one(~whole, F.concat(F.lit("head "), read["state"])),
        F.when(whole, F.transform(read["odd"], lambda x: F.concat(F.lit("head line "), x))).otherwise(F.array().cast(_FAULT)),
        *lists,
        F.when(whole, missing).otherwise(F.array().cast(_FAULT)),
        one(whole & kind.isNotNull() & ~kind.isin(*PAGE_SECTIONS), F.concat(F.lit("unknown page type "), kind)),
        one(whole & kind.isNotNull() & ~F.coalesce(kind == F.col("page_type"), F.lit(False)), "page types differ"),
        one(F.coalesce(F.size("claim_ids"), F.lit(0)) <= 0, "no claims"),
        F.when(whole, wanted).otherwise(F.array().cast(_FAULT)),
    )
    told = rows.select("page_id", F.explode(faults).alias("fault"))
    status = claims.select("claim_id", F.when((F.coalesce("citation_locator", F.lit("")) != "") & ~F.coalesce("confidence_status", F.lit("weak")).isin("weak", "uncited"), "cited").otherwise("weak").alias("status"))
    used = rows.select("page_id", F.explode("claim_ids").alias("claim_id")).join(status, "claim_id", "left")
    by_claim = used.filter("status IS NULL OR status = 'weak'").select("page_id", F.concat(F.when(F.col("status").isNull(), "unknown claim ").otherwise("weak claim "), "claim_id").alias("fault"))
    uncited = used.groupBy("page_id").agg(F.count(F.when(F.col("status") == "cited", 1)).alias("n")).filter("n = 0").select("page_id", F.lit("no cited claims").alias("fault"))
    return told.unionByName(by_claim).unionByName(uncited).distinct()
