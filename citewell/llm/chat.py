"""Chat formatting with loss masks that are aligned to the tokenizer's offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of assistant texts are cut with the tokens' spans by binary search.
Control strings that occur inside a text are escaped by backslashes before
them, and read back without loss.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings; none holds a blank or a backslash.
_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]"
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({_CONTROL})"), re.compile(rf"(\\+)(?={_CONTROL})")
_MARK = re.compile(rf"(?<!\\)(?:{_CONTROL})")
#: Opening and closing string of each role; any other role is named before a user's pair.
_TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_ROLES = {opening: role for role, (opening, _) in _TURNS.items()}

_FORMATTED = "conv_id long, formatted string, ids array<int>, mask array<boolean>, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" * (len(m[1]) // 2), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        opening, closing = _TURNS.get(role, _TURNS["user"])
        head = "" if role in _TURNS else f"[ROLE] {escape(role)} [/ROLE]"
        body = escape(text)
        parts += [head, opening, " ", body, " ", closing]
        start = at + len(head) + len(opening) + 1
        if role == "assistant":
            spans.append((start, start + len(body)))
        at = start + len(body) + 1 + len(closing)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, named, marks = [], None, [m.span() for m in _MARK.finditer(formatted)]
    for (a, b), (c, _) in zip(marks[::2], marks[1::2], strict=True):
        text = unescape(formatted[b + 1 : c - 1])
        if formatted[a:b] == "[ROLE]":
            named = text
        else:
            turns.append((_ROLES[formatted[a:b]] if named is None else named, text))
            named = None
    return turns


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Tokens that meet a span, and the characters under the mask as disjoint intervals within single spans."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool), []
    bounds = np.array(spans)
    first = np.searchsorted(bounds[:, 1], offsets[:, 0], side="right")
    last = np.searchsorted(bounds[:, 0], offsets[:, 1], side="left")
    mask = first < last
    out: list[tuple[int, int]] = []
    for t in np.flatnonzero(mask).tolist():
        for s in range(first[t], last[t]):
            a, b = max(int(offsets[t, 0]), spans[s][0]), min(int(offsets[t, 1]), spans[s][1])
            if out and a <= out[-1][1] and out[-1][0] >= spans[s][0]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif a < b:
                out.append((a, b))
    return mask, out


def format_chats(spark: SparkSession, conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, formatted, ids, mask (by token), loss (masked characters) of each conversation(conv_id, turn, role, text).

    Rows are ordered by turn, then role and text; repeated rows are turns of their own.  Null texts and roles are
    empty; rows without a conv_id form one conversation; extra columns are ignored; no rows give no conversations.
    A conversation is one text and is held by one task; a partition's others stream past.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        known.encode_special_tokens = True

        def made(held: list[tuple[object, str, list]]) -> pa.RecordBatch:
            rows = []
            for name, text, spans in held:
                encoding = known.encode(text, add_special_tokens=False)
                mask, loss = masked(np.array(encoding.offsets, np.int64).reshape(-1, 2), spans)
                rows.append((name, text, encoding.ids, mask.tolist(), [{"start": a, "end": b} for a, b in loss]))
            names, texts, ids, masks, losses = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(losses, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["conv_id", "formatted", "ids", "mask", "loss"],
            )

        turns, name, held = [], None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if turns and conv != name:
                    held.append((name, *render(turns)))
                    turns = []
                    if sum(len(x[1]) for x in held) > 1_000_000:
                        yield made(held)
                        held = []
                name = conv
                turns.append((role or "", text or ""))
        if turns:
            held.append((name, *render(turns)))
        if held:
            yield made(held)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, read back from the formatted texts and the masked characters alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, loss in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                turns = read_back(text)
                learned = [unescape(text[x["start"] : x["end"]]) for x in loss]
                sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
                out.append((name, len(turns), sha([f"{r}\n{t}\n" for r, t in turns]), sum(map(len, learned)), sha(learned), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts look like the template."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\])', '\1\1\\\2', 'g') AS body FROM c),
s AS (SELECT *, length(body) + 2 + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
  ELSE 13 + 15 + length(regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\])', '\1\1\\\2', 'g')) END AS n FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
