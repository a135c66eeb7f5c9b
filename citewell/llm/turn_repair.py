"""Cheapest repair of damaged conversations by integer weights.

A repair is a path through the turns of a conversation and the four states of
its role pattern ``(s?(ua)+)?``.  The weight of a path is one integer: its high
digits are the cost, its low digits, of a fixed width in base 8, are the audit
letters in order, filled with zeros at the end.  The smaller of two weights is
thus the cheaper repair, and of equally cheap ones that of the audit that comes
first in ASCII, a prefix before its extensions; the dynamic program takes
minima of integers and nothing else.  It goes from the last turn to the first,
since letters are put in front: an order between two rests of one conversation
stays as it is when both get the same letter in front.

A conversation is dealt over tasks by ranges of its turns.  Each stretch of at
most ``STRETCH`` turns gives the least weight from every state to every state,
and stretches are put in front of each other in the same way as letters.  Two
equally cheap audits of one stretch that join the same states can't be a
beginning of one another, as only inserts, which cost, could follow; so the
better of them stays better whatever follows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Turns of one dynamic program; longer stretches are cut and joined.
STRETCH = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "DIKR"
_DIGIT = {letter: i + 1 for i, letter in enumerate(LETTERS)}
#: States: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or renamed turn leads, and the roles that it gets.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: High digits of what can't be reached; no sum of costs gets there.
_NEVER = 1 << 60

Path = tuple[int, str]  # cost, audit


def put_in_front(weight: int, cost: int, audit: str, width: int) -> int:
    """The weight of a path that begins with these letters, at this cost, and goes on as ``weight`` says."""
    at = 3 * width
    digits = int("".join(str(_DIGIT[x]) for x in audit), 8) if audit else 0
    return ((weight >> at) + cost) << at | digits << (at - 3 * len(audit)) | (weight & ((1 << at) - 1)) >> (3 * len(audit))


def path(weight: int, width: int) -> Path | None:
    """Cost and audit of a weight; None if its end can't be reached."""
    cost, low = weight >> 3 * width, weight & ((1 << 3 * width) - 1)
    return None if cost >= _NEVER else (cost, format(low, f"0{width}o").rstrip("0").translate(str.maketrans("1234", LETTERS)) if width else "")


@functools.lru_cache(50_000)
def stretch(codes: str) -> tuple[tuple[Path | None, ...], ...]:
    """[from][to]: the least path over a stretch of turns.

    A turn is two characters: its role's initial (s, u, a, or - for others), and x if it must go, t if it is truncated, else a dot.
    """
    turns = [codes[i : i + 2] for i in range(0, len(codes), 2)]
    width = 3 * len(turns)  # before each turn two inserts at most: a third would come back to a state it has left
    letter = functools.partial(put_in_front, width=width)
    found = []
    for end in range(4):
        after = [0 if s == end else _NEVER << 3 * width for s in range(4)]
        for initial, state in reversed(turns):
            row = []
            for s in range(4):
                best = letter(after[s], DELETE, "D")
                if state != "x":
                    more = TRUNCATED * (state == "t")
                    best = min(best, letter(after[_NEXT[s]], REROLE + more, "R"))
                    if (initial, s) in _KEPT:
                        best = min(best, letter(after[_KEPT[initial, s]], KEEP + more, "K"))
                row.append(best)
            once = [min(row[s], letter(row[_NEXT[s]], INSERT, "I")) for s in range(4)]
            after = [min(row[s], letter(once[_NEXT[s]], INSERT, "I")) for s in range(4)]
        found.append([path(w, width) for w in after])
    return tuple(tuple(found[end][s] for end in range(4)) for s in range(4))


def joined(stretches: list[list[list[Path | None]]]) -> Path:
    """The least repair of a conversation whose stretches come in this order."""
    width = 2 + sum(max(len(p[1]) for row in one for p in row if p) for one in stretches)
    after = [put_in_front(0, INSERT * len(end), end, width) for end in ("", "II", "I", "")]
    for one in reversed(stretches):
        after = [min(put_in_front(after[t], *p, width) for t, p in enumerate(one[s]) if p) for s in range(4)]
    return path(after[START], width)


# tables


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: the damaged rows; times is 0 for dropped ones, and counts equal ones."""
    kind = F.crc32(F.encode(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(_or_space("role")).alias("role"), text.alias("text"), times.alias("times"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def _with_first(rows: DataFrame) -> DataFrame:
    """later: an earlier turn of the conversation has the same role and text.  Equal turns were counted together before."""
    said = F.sha1(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"))
    rows = rows.withColumn("said", said).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    again = rows.filter("times > 0").groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    return met.select("conv_id", "turn", "role", "text", "times", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))


_PATHS = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
_STRETCHES = (
    "conv_id long, part int, number long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long, paths array<array<struct<cost:long,audit:string>>>"
)
_STRETCH_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, _PATHS]
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.replace(", ", ",").split("<")[0].split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_KNOWN = {initial: initial for initial in "sua"}
_ADJACENT = {("s", "u"), ("u", "a"), ("a", "u")}


class _Stretch:
    """Counts of one stretch while its turns pass."""

    def __init__(self, conv: object) -> None:
        self.conv, self.codes, self.turns, self.counts, self.illegal = conv, [], 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.first is None:
            self.first = initial
        elif (self.last, initial) not in _ADJACENT:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.codes.append(_KNOWN.get(initial, "-") + ("t" if fault == "truncated" else "x" if fault else "."))

    def row(self, part: int, number: int) -> tuple:
        paths = [[p and {"cost": p[0], "audit": p[1]} for p in row] for row in stretch("".join(self.codes))]
        return (self.conv, part, number, *self.counts.values(), self.illegal, self.first, self.last, self.first_turn, self.last_turn, self.turns, paths)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, now, out = TaskContext.get().partitionId(), 0, None, []
    for batch in batches:
        for conv, turn, role, times, blank, open_end, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row(part, number))
                    number += 1
                now = _Stretch(conv)
            for copy in range(times):
                if len(now.codes) >= STRETCH:
                    out.append(now.row(part, number))
                    number, now = number + 1, _Stretch(conv)
                now.add(turn, role, "blank" if blank else "duplicate" if later or copy else "truncated" if open_end else "")
        if len(out) >= 1000:
            yield _batch(out, _STRETCHES, _STRETCH_KINDS)
            out = []
    if now is not None:
        out.append(now.row(part, number))
    if out:
        yield _batch(out, _STRETCHES, _STRETCH_KINDS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its stretches in order."""

    def made(held: list[dict]) -> tuple:
        full = [x for x in held if x["first_initial"] is not None]
        numbered = [x for x in full if x["first_turn"] is not None]
        split = sum(a["last_turn"] == b["first_turn"] for a, b in zip(numbered, numbered[1:], strict=False))
        gaps = numbered[-1]["last_turn"] - numbered[0]["first_turn"] + 1 - (sum(x["turns"] for x in numbered) - split) if numbered else 0
        seams = sum((a["last_initial"], b["first_initial"]) not in _ADJACENT for a, b in zip(full, full[1:], strict=False))
        cost, audit = joined([[[p and (p["cost"], p["audit"]) for p in row] for row in x["paths"]] for x in full])
        return (held[0]["conv_id"], gaps, *(sum(x[c] for x in held) for c in ("blank", "duplicate", "truncated")), sum(x["illegal"] for x in held) + seams, cost, audit)

    kinds, held, out = [*[pa.int64()] * 7, pa.string()], [], []
    for batch in batches:
        for x in batch.to_pylist():
            if held and held[0]["conv_id"] != x["conv_id"]:
                out.append(made(held))
                held = []
            held.append(x)
        if len(out) >= 1000:
            yield _batch(out, _RESULT, kinds)
            out = []
    out += [made(held)] if held else []
    if out:
        yield _batch(out, _RESULT, kinds)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's row with its audit comes first; then its turns pass, one at a time.  Gives the repaired turns."""
    schema, kinds = "conv_id long, position long, role string, text string", [pa.int64(), pa.int64(), pa.string(), pa.string()]
    out, conv, audit, at, state, position = [], None, "", 0, START, 0

    def inserts() -> None:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            out.append((conv, position, _ROLE[state], ""))
            at, state, position = at + 1, _NEXT[state], position + 1

    for batch in batches:
        for name, given, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if given is not None:
                inserts()
                conv, audit, at, state, position = name, given, 0, START, 0
                continue
            for _ in range(times):
                inserts()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                out.append((conv, position, _ROLE[state] if letter == "R" else role, text))
                state, position = _NEXT[state] if letter == "R" else _KEPT[role[:1], state], position + 1
        if len(out) >= 1000:
            yield _batch(out, schema, kinds)
            out = []
    inserts()
    if out:
        yield _batch(out, schema, kinds)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the digest of its turns, which pass in order."""
    schema, kinds, out, conv, sha = "conv_id long, repaired_sha256 string", [pa.int64(), pa.string()], [], None, None
    for batch in batches:
        for name, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if position == 0:
                out += [(conv, sha.hexdigest())] if sha else []
                conv, sha = name, hashlib.sha256()
            sha.update((f"{role}:{text}" if position == 0 else f"\n{role}:{text}").encode())
        if len(out) >= 1000:
            yield _batch(out, schema, kinds)
            out = []
    out += [(conv, sha.hexdigest())] if sha else []
    if out:
        yield _batch(out, schema, kinds)


def repair(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, times): counts, cost and audit by conversation, and its repaired turns.

    The first frame has a row for each conv_id, those whose rows all have 0 times included; the second (conv_id,
    position, role, text) is sorted within partitions.  Turns go by number, null first, then role and text; of equal
    rows the first may stay.  An initial other than s, u and a can only be renamed or deleted.  Rows without a
    conv_id are one conversation; extra columns are ignored; no rows give no conversations.

    Ranges of (conv_id, turn, role, text) deal the turns of a long conversation over tasks.  Only the last pass, which
    writes out a conversation in order, has all its turns in one task, one at a time.
    """
    held = scratch.write(spark, _with_first(rows), "turns")
    order = ["conv_id", "turn", "role", "text"]
    flags = [~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")]
    cut = held.select("conv_id", "turn", "role", "text", "times", flags[0].alias("blank"), flags[1].alias("open_end"), "later")
    ranged = cut.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order).drop("text").select("conv_id", "turn", "role", "times", "blank", "open_end", "later")
    parts = ranged.mapInArrow(_stretches, _STRETCHES)
    found = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(_whole, _RESULT)
    found = scratch.write(spark, found, "repairs")

    turns = held.filter("times > 0").select(*order, "times", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("side"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    audits = found.select("conv_id", none("turn", "long"), none("role", "string"), none("text", "string"), none("times", "long"), "audit", F.lit(0).alias("side"))
    both = audits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "role", "text")
    return found, both.select("conv_id", "audit", "role", "text", "times").mapInArrow(_applied, "conv_id long, position long, role string, text string")


def digest(found: DataFrame, turns: DataFrame) -> DataFrame:
    """The counts with the digest of each conversation's repaired turns, read from those turns."""
    hashed = turns.mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(*found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(who, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
_MORE = {USER: "f2", ASSISTANT: "f3", SYSTEM: "f1"}


def _edits(s: int) -> str:
    """Weights as text in the SQL: nine digits of cost, then the audit; NULL is out of reach."""
    put = lambda f, cost, letter: f"printf('%09d', left({f}, 9)::INT + {cost}) || '{letter}' || substr({f}, 10)"
    kept = "".join(f" WHEN i = '{i}' THEN {put(_MORE[t], 'o', 'K')}" for (i, at), t in _KEPT.items() if at == s)
    return f"least({put(f'f{s}', 3, 'D')}, CASE WHEN NOT gone THEN {put(_MORE[_NEXT[s]], '2 + o', 'R')} END, CASE WHEN gone THEN NULL{kept} END) AS r{s}"


_INSERTED = "printf('%09d', left({0}, 9)::INT + 2) || 'I' || substr({0}, 10)"
SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS who FROM conversations),
k AS (SELECT *, {_CRC} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, left(role, 1) AS i, NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open_end,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (NOT blank AND again)::BIGINT AS duplicate,
  count(*) FILTER (NOT blank AND NOT again AND open_end)::BIGINT AS truncated, count(*) FILTER (coalesce(illegal, false))::BIGINT AS illegal FROM f GROUP BY conv_id),
w AS (SELECT conv_id, n, '000000000' AS f0, '000000004II' AS f1, '000000002I' AS f2, '000000000' AS f3 FROM a
  UNION ALL SELECT conv_id, n - 1, least(q0, {_INSERTED.format("q2")}, {_INSERTED.format("o2")}), least(q1, {_INSERTED.format("q2")}, {_INSERTED.format("o2")}), least(q2, o2), least(q3, o3) FROM (
    SELECT *, {_INSERTED.format("q3")} AS o2, {_INSERTED.format("q2")} AS o3 FROM (SELECT conv_id, n, r0 AS q0, r1 AS q1, r2 AS q2, r3 AS q3 FROM (
      SELECT w.conv_id, w.n, {", ".join(_edits(s) for s in range(4))}
      FROM (SELECT w.*, f.i, f.blank OR f.again AS gone, CASE WHEN f.open_end THEN 1 ELSE 0 END AS o FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n) w)))),
b AS (SELECT conv_id, left(f0, 9)::BIGINT AS cost, substr(f0, 10) AS audit FROM w WHERE n = 0),
l AS (SELECT conv_id, p, substr(audit, p, 1) AS letter FROM b, unnest(range(1, length(audit) + 1)) AS t(p)),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS n FROM l),
e AS (SELECT m.conv_id, m.p, m.letter, f.role, f.text, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.p) AS place FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.n = m.n AND letter <> 'I' WHERE letter <> 'D'),
g AS (SELECT *, place + max((place = 1 AND letter = 'K' AND left(role, 1) = 's')::INT) OVER (PARTITION BY conv_id) AS spot FROM e),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN spot % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM g GROUP BY conv_id)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM v.conv_id
"""
