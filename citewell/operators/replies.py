"""Prompts over retrieved evidence, and what the replies to them say: VARIANT values, checked against the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Keys of an answer.
KEYS = ("short_answer", "analysis", "citations", "uncertainties", "conflicts", "suggested_title")
SYSTEM = (
    "Answer from the retrieved evidence alone. Every factual conclusion cites the claim_id, source_id and citation_locator of what was retrieved. "
    f"Show weak evidence and contradictions. Return only JSON with the keys {', '.join(KEYS)}."
)
AGAIN = "Return valid JSON only, without Markdown fences and without prose around it."


def prompts(asked: DataFrame) -> DataFrame:
    """answer_id, messages, repair (arrays of role, content) of asked(answer_id, question, contexts, relationships, warnings arrays).

    The repair prompt is the first one and a demand for bare JSON.  Null arrays are empty, a null question too.
    """
    listed = [F.coalesce(c, F.array()).alias(c) for c in ("contexts", "relationships", "warnings")]
    evidence = F.to_json(F.struct(*listed), {"ignoreNullFields": "false"})
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.lit("Question:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nRetrieved evidence:\n"), evidence)
    rows = asked.select("answer_id", F.array(message("system", F.lit(SYSTEM)), message("user", user)).alias("messages"))
    return rows.withColumn("repair", F.array_append("messages", message("user", F.lit(AGAIN))))


def _text(v: Column) -> Column:
    """A value as text: strings as they are, other values as JSON, missing ones and JSON null as the empty text."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit(""))


def _field(v: Column, name: str) -> Column:
    found = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(found.isNull() | F.is_variant_null(found), F.lit("")).otherwise(_text(found))


def _list(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def parsed(replies: DataFrame) -> DataFrame:
    """answer_id, problem, answer, analysis, title, uncertainties, conflicts, citations of replies(answer_id, reply).

    Problem is the first that holds: not JSON, no object, citations are no list; else null.  Null and empty replies and
    objects that repeat a key are not JSON.  citations are structs (claim_id, source_id, citation_locator) in order, null
    for an element that is no object.  Notes that are no list are none; blank notes are left out.
    """
    v, listed = F.col("_v"), _list(F.col("_v"), "citations")
    rows = replies.select("answer_id", F.try_parse_json("reply").alias("_v"))
    problem = F.when(v.isNull(), "not JSON").when(~_is_object(v), "no object").when(listed.isNull(), "citations are no list")
    cited = lambda c: F.when(_is_object(c), F.struct(*[_field(c, n).alias(n) for n in ("claim_id", "source_id", "citation_locator")]))
    none = F.array().cast("array<string>")
    notes = lambda name: F.filter(F.transform(F.coalesce(_list(v, name), F.array().cast("array<variant>")), _text), lambda x: T.strip(x) != "")
    good = F.col("problem").isNull()
    rows = rows.withColumn("problem", problem)
    return rows.select(
        "answer_id", "problem", *[F.when(good, _field(v, key)).alias(name) for key, name in (("short_answer", "answer"), ("analysis", "analysis"), ("suggested_title", "title"))],
        *[F.when(good, notes(name)).otherwise(none).alias(name) for name in ("uncertainties", "conflicts")], F.when(good, F.transform(listed, cited)).alias("citations"),
    )


def settled(replies: DataFrame, contexts: DataFrame) -> DataFrame:
    """answer_id, status, warning, repaired, answer, analysis, title, uncertainties, conflicts, citations of replies(answer_id, reply, repair).

    Only a reply that is not JSON is asked for again, and then ``repair`` counts.  contexts(answer_id, claim_id,
    source_id, citation_locator, page_path) are the evidence.  An answer has one row for each answer_id; its warning is
    the first problem, by place in the list of citations: one that is no object, a claim outside the evidence, another
    source or locator than the claim's; or that nothing is cited.  Only an answered one has citations, with their pages.
    """
    first = parsed(replies.select("answer_id", "reply"))
    again = first.filter(F.col("problem") == "not JSON").select("answer_id").join(replies.select("answer_id", F.col("repair").alias("reply")), "answer_id")
    rows = first.filter(~F.col("problem").eqNullSafe("not JSON")).withColumn("repaired", F.lit(False)).unionByName(parsed(again).withColumn("repaired", F.lit(True)))
    each = rows.select("answer_id", F.posexplode("citations").alias("place", "c")).select("answer_id", "place", "c", F.col("c.claim_id").alias("claim_id"))
    known = contexts.select("answer_id", "claim_id", F.col("source_id").alias("_source"), F.col("citation_locator").alias("_locator"), "page_path").dropDuplicates(["answer_id", "claim_id"])
    named = each.join(known, ["answer_id", "claim_id"], "left")
    says = lambda text: F.concat(F.lit(text), F.lit(" "), "claim_id")
    wrong = (
        F.when(F.col("c").isNull(), "citation is no object").when(F.col("_source").isNull(), says("claim outside the evidence"))
        .when(F.col("c.source_id") != F.col("_source"), says("other source of")).when(F.col("c.citation_locator") != F.coalesce("_locator", F.lit("")), says("other locator of"))
    )
    cited = F.struct("place", "claim_id", F.col("c.source_id").alias("source_id"), F.col("c.citation_locator").alias("locator"), "page_path")
    held = named.withColumn("wrong", wrong).groupBy("answer_id").agg(
        F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("place"))).alias("wrong"), F.array_sort(F.collect_list(cited)).alias("_cited")
    )
    rows = rows.drop("citations").join(held, "answer_id", "left")
    warning = F.coalesce("problem", "wrong", F.when(F.col("_cited").isNull(), "nothing cited"))
    status = F.when(F.col("problem").isNotNull(), "llm_failed").when(warning.isNotNull(), "invalid_citations").otherwise("answered")
    plain = F.transform("_cited", lambda c: F.struct(*[c[n].alias(n) for n in ("claim_id", "source_id", "locator", "page_path")]))
    return rows.withColumn("warning", warning).withColumn("status", status).select(
        "answer_id", "status", "warning", "repaired", "answer", "analysis", "title", "uncertainties", "conflicts", F.when(F.col("status") == "answered", plain).alias("citations")
    )
