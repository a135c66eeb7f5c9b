"""What a question is searched by: terms, synonyms, n-grams, formulas and symbols."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.store import in_blocks
from .text import nfkc, strip

#: Question words, and synonyms of the domain.
STOP_TERMS = ("应该", "怎么", "如何", "为什么", "吗", "呢", "可以", "是否", "哪个", "哪种", "什么")
EXPANSIONS = {
    "保存": ("冷藏", "储存", "存放", "久放", "尽快食用", "保持干燥"),
    "储存": ("保存", "冷藏", "存放", "久放"),
    "营养": ("维生素", "膳食纤维", "矿物质", "热量"),
    "怎么吃": ("食用", "搭配", "做法", "适合"),
    "适合": ("建议", "不建议", "人群", "注意"),
    "补充": ("富含", "含有", "摄入"),
    "比较": ("哪种", "更", "优势", "差异"),
    "血糖": ("糖分", "含糖量", "不建议", "控制血糖"),
    "糖分": ("含糖量", "血糖", "不建议"),
    "能量": ("热量", "糖分", "注意"),
}
#: Scripts without blanks, and what a formula is.
_CJK = r"㐀-鿿"
_FORMULA = re.compile(r"(?i)\b[A-Z][A-Z0-9₀-₉⁰-⁹¹²³]*\b(?:\s*[=+\-*/^]\s*[A-Z0-9₀-₉⁰-⁹¹²³]+)+|\b[A-Z][A-Z0-9₀-₉⁰-⁹¹²³]*[₀-₉⁰-⁹¹²³0-9][A-Z0-9₀-₉⁰-⁹¹²³]*\b")


def _array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unique(terms: Column) -> Column:
    """First-seen order, without blanks."""
    return F.filter(F.array_distinct(F.transform(terms, strip)), lambda x: x != "")


def stop_terms(text: Column) -> Column:
    return F.filter(_array(*STOP_TERMS), lambda x: F.contains(text, x))


def without_stop_terms(text: Column) -> Column:
    for term in STOP_TERMS:
        text = F.replace(text, F.lit(term), F.lit(""))
    return text


def text_terms(text: Column, catalog: Column) -> Column:
    """Catalog matches, words, scripts with digits, domain terms, keys with synonyms, and short runs; no question words."""
    domain = F.when(text.rlike(r"(?i)维生素\s*C"), _array("维生素C", "维生素")).otherwise(_array())
    keys = F.filter(_array(*EXPANSIONS), lambda x: F.contains(text, x))
    runs = F.filter(all_of(without_stop_terms(text), f"[{_CJK}]{{2,}}"), lambda x: F.length(x) <= 4)
    found = F.concat(catalog, all_of(text, "[A-Za-z0-9_]{2,}"), all_of(text, f"[{_CJK}]+[A-Za-z0-9]+"), domain, keys, runs)
    return F.filter(unique(found), lambda x: ~x.isin(*STOP_TERMS))


def expanded_terms(terms: Column) -> Column:
    table = F.create_map(*[x for key, values in EXPANSIONS.items() for x in (F.lit(key), _array(*values))])
    return unique(F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), _array()))))


def ngrams(text: Column, least: int = 2, most: int = 4) -> Column:
    """Character n-grams of unbroken runs, by run, then length, then place."""
    sized = lambda run, n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - n + 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(_array())
    runs = all_of(without_stop_terms(text), f"[{_CJK}]+")
    return unique(F.flatten(F.transform(runs, lambda run: F.concat(*[sized(run, n) for n in range(least, most + 1)]))))


def symbol_spans(text: Column) -> Column:
    spans = F.concat(all_of(text, r"[Ͱ-Ͽ]+(?:/[ \t]*[Ͱ-Ͽ]+)+"), all_of(text, r"[\p{So}\p{Sm}\p{Sc}\p{Sk}]"))
    return unique(F.transform(spans, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


@F.pandas_udf(ArrayType(StringType()))
def formula_spans(original: pd.Series, normalized: pd.Series) -> pd.Series:
    """Operator chains and tokens with digits; Java's word boundaries do not know sub- and superscripts."""
    return pd.Series([list(dict.fromkeys(m.replace(" ", "") for text in pair for m in _FORMULA.findall(text or ""))) for pair in zip(original, normalized, strict=True)])


@in_blocks
def analyze(questions: DataFrame, catalog_terms: DataFrame | None = None) -> DataFrame:
    """questions(query_id, question) with all features of each.

    Catalog terms (term) that occur in a question are listed longest first, then by name.
    """
    rows = questions.withColumn("normalized", strip(nfkc("question")))
    if catalog_terms is None:
        rows = rows.withColumn("catalog_terms", _array())
    else:
        terms = catalog_terms.select(strip(nfkc("term")).alias("term")).filter(F.col("term") != "").distinct()
        runs = lambda n: F.regexp_extract_all("low", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        texts = rows.select("query_id", F.lower("normalized").alias("low")).withColumn("start", F.explode(F.array_distinct(F.concat(runs(3), runs(2), runs(1)))))
        pairs = texts.join(terms.withColumn("start", F.substring(F.lower("term"), 1, 3)), "start").filter(F.contains("low", F.lower("term")))
        matched = pairs.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))), lambda x: x["term"]).alias("catalog_terms"))
        rows = rows.join(matched, "query_id", "left").withColumn("catalog_terms", F.coalesce("catalog_terms", _array()))
    rows = rows.withColumn("stop_terms", stop_terms(F.col("normalized"))).withColumn("text_terms", text_terms(F.col("normalized"), F.col("catalog_terms")))
    rows = rows.withColumn("expanded_terms", expanded_terms(F.col("text_terms"))).withColumn("ngrams", ngrams(F.col("normalized")))
    rows = rows.withColumn("formula_spans", formula_spans("question", "normalized")).withColumn("symbol_spans", symbol_spans(F.col("question")))
    return rows.withColumn("exact_spans", unique(F.concat("catalog_terms", "formula_spans", "symbol_spans")))


def catalog_terms(pages: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """term: every title, alias and normalized alias of a catalog once, blank ones left out."""
    columns = [pages.select("title"), aliases.select("alias"), aliases.select("normalized_alias"), sources.select("title")]
    rows = reduce(DataFrame.union, columns).toDF("term")
    return rows.filter(F.trim("term") != "").distinct()


def diagnostics(questions: DataFrame) -> DataFrame:
    """query_id, kind, n: how many terms of each kind an analyzed question has."""
    kinds = ("text_terms", "expanded_terms", "catalog_terms", "exact_spans", "symbol_spans", "formula_spans", "ngrams", "stop_terms")
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.size(c).cast("long").alias("n")) for c in kinds])
    return questions.select("query_id", F.inline(pairs))
