"""Scalar text functions as columns; nothing leaves the JVM but NFKC and HTML entities."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a claim may not start with, and headings that are no claims.
METADATA_PREFIXES = ("topic:", "created for:", "author:", "date:", "source:", "tags:", "status:", "title:")
CONTENTS_WORDS = ("contents", "table of contents", "introduction", "scope", "overview")
PAGE_ORDER = ("source", "concept", "entity", "synthesis")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def duplicate_key(text: Column) -> Column:
    """The form in which two claims count as the same text."""
    return squeeze(F.lower(text))


def summarize(text: Column, limit: int) -> Column:
    """Squeezed and cut to ``limit`` characters, an ellipsis included."""
    whole = squeeze(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, limit - 3), r"\s+$", ""), F.lit("...")))


def slugify(text: Column) -> Column:
    """Letters and digits of any script; what lies between becomes one hyphen."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def normalize_alias(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def alias_keys(text: Column) -> Column:
    """Keys under which two titles or aliases are the same, two fixed equivalences included."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    spaced, compact = F.array_join(words, " "), F.array_join(words, "")
    rag = F.contains(spaced, F.lit("retrieval augmented generation")) | F.array_contains(words, "rag")
    openai = F.contains(spaced, F.lit("open ai")) | F.contains(compact, F.lit("openai"))
    named = F.array(compact, F.when(rag, F.lit("rag")), F.when(rag, F.lit("retrievalaugmentedgeneration")), F.when(openai, F.lit("openai")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(named))))


def title_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def yaml_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def heading(line: Column) -> Column:
    """The text of a Markdown heading, else null."""
    found = F.regexp_extract(line, r"^\s{0,3}#{1,6}\s+(.+?)\s*$", 1)
    return F.when(found != "", strip(found))


def title(text: Column, fallback: Column) -> Column:
    """The first heading or the start of the first line with text, whichever comes first."""
    first = strip(F.regexp_extract(text, r"\A\s*(\S[^\n]*)", 1))
    return F.when(first.startswith("# "), strip(F.substring(first, 3, 1 << 30))).when(first != "", F.substring(first, 1, 80)).otherwise(fallback)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) where the value is computed once, however often it is used: filters would repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _states_something(bare: Column, low: Column) -> Column:
    meta = F.lit(False)
    for prefix in METADATA_PREFIXES:
        meta = meta | low.startswith(prefix)
    words = bare.rlike(r"^\S++\s++\S++\s++\S++\s++\S")
    return words & ~meta & ~bare.endswith(":") & bare.rlike(r"\p{L}") & ~F.regexp_replace(low, r"^[ .:-]+|[ .:-]+$", "").isin(*CONTENTS_WORDS)


def is_claim(line: Column) -> Column:
    """A line that states something: no heading, list label, metadata or contents entry, and four words at least."""
    bare = lambda text: strip(F.regexp_replace(text, r"^[-*+]\s+", ""))
    stated = lambda text: let(bare(text), lambda x: let(F.lower(x), lambda low: _states_something(x, low)))
    return let(strip(line), lambda text: ~text.startswith("#") & ~text.startswith("[unsupported-") & stated(text))


def has_line_locator(locator: Column) -> Column:
    return locator.rlike(r"(^|;)line:[1-9]\d*(;|$)")


def confidence(locator: Column, stated: Column) -> Column:
    """cited with a line locator; without one what is stated, but cited and anything unknown are weak."""
    known = F.lower(F.coalesce(stated, F.lit("")))
    return F.when(F.coalesce(has_line_locator(locator), F.lit(False)), F.lit("cited")).when(known == "uncited", F.lit("uncited")).otherwise(F.lit("weak"))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"sk-[A-Za-z0-9_-]+", "sk-***")


def safe_filename(name: Column) -> Column:
    """A name without folders and odd characters, its suffix in lower case; nothing left is "source"."""
    base = F.element_at(F.split(name, "/"), -1)
    suffix = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    stem = F.regexp_replace(F.substring(base, F.lit(1), F.length(base) - F.length(suffix)), r"[^A-Za-z0-9._-]+", "-")
    stem = F.regexp_replace(stem, r"^-+|-+$", "")
    return F.concat(F.when(stem == "", F.lit("source")).otherwise(stem), F.regexp_replace(F.lower(suffix), r"[^A-Za-z0-9.]+", ""))


def bare_object(reply: Column) -> Column:
    """The JSON object of a reply: without a code fence, from the first brace to the last; null where there is none."""
    plain = F.regexp_replace(F.regexp_replace(strip(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner)


def json_keys(text: Column, names: tuple[str, ...]) -> Column:
    """Which of some names are keys anywhere in a JSON text: a quoted name before a colon is a key at every depth."""
    found = F.regexp_extract_all(text, F.lit(r'(?<!\\)"(' + "|".join(names) + r')"\s*:'), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def html_to_text(page: Column) -> Column:
    """Text of a page; the five basic entities and numbers below are unescaped by ``unescape_html``."""
    text = F.regexp_replace(page, r"(?is)<script.*?>.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style.*?>.*?</style>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>", "\n\n")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def basic_entities(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def squeeze_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All HTML entities; Spark has no function for them."""
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no function for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
