"""Secret scans over every version of every file, with a ledger of what has been scanned.

A version's content address is the SHA-256 of its text.  Only contents that the
ledger does not hold for a rule version are scanned, each once however many
versions share it; findings are joined back to all versions.  Everything is
DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

#: Versions of one content from which on they find its spans by broadcast, and the spans of such contents that are broadcast.
HOT, BROADCAST_SPANS = 1000, 500_000

_LEDGER = "sha string, scanned array<string>, hits array<struct<rule:string,gaps:array<int>,lens:array<int>,sizes:array<int>>>"


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, sha of every row; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))


def _hit(rule: Rule, unseen: Column) -> Column:
    """Lengths of what lies between the matches, of the matches, and of the group that decides."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    lengths = lambda x: F.transform(x, lambda s: F.length(s))
    found = F.struct(
        F.lit(rule.key).alias("rule"),
        lengths(F.split(text, rule.pattern, -1)).alias("gaps"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("lens"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("sizes"),
    )
    return F.when(F.array_contains(unseen, rule.key) & text.rlike(rule.pattern), found)


def scan_new(contents: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the contents (sha, text), one each, for the rule versions that the ledger lacks."""
    blobs = contents.groupBy("sha").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("unseen", wanted)
    else:
        seen = ledger.select("sha", F.explode("scanned").alias("key")).groupBy("sha").agg(F.collect_set("key").alias("seen"))
        blobs = blobs.join(seen, "sha", "left").withColumn("unseen", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("unseen") > 0)
    return blobs.select("sha", F.col("unseen").alias("scanned"), F.array_compact(F.array(*[_hit(r, F.col("unseen")) for r in rules])).alias("hits"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """sha, kind, rank, start, end (code points, end exclusive) of all matches that hold under these rule versions."""
    table = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("rank"), F.lit(r.least).alias("least")) for i, r in enumerate(rules)])
    hits = ledger.select("sha", F.explode("hits").alias("hit")).withColumn("known", F.get(F.filter(table, lambda x: x["rule"] == F.col("hit.rule")), F.lit(0))).filter(F.col("known").isNotNull())
    rows = hits.select("sha", "known.kind", "known.rank", "known.least", F.posexplode(F.arrays_zip("hit.gaps", "hit.lens", "hit.sizes")).alias("pos", "m")).filter(F.col("m.lens").isNotNull())
    so_far = Window.partitionBy("sha", "rank").orderBy("pos")
    end = F.sum(F.col("m.gaps") + F.col("m.lens")).over(so_far)
    return rows.withColumn("end", end).filter(F.col("m.sizes") >= F.col("least")).select("sha", "kind", "rank", (F.col("end") - F.col("m.lens")).alias("start"), "end")


def scan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = BASE, ledger_path: str | None = None) -> DataFrame:
    """doc_id, sha, spans (array of kind, start, end by start, then rule order) for every row of documents(doc_id, text).

    With a ledger path, contents that it holds are not scanned again and what is scanned is appended to it; else
    the ledger lives in the shared scratch folder.  Null texts count as empty; a row without findings has an
    empty array; repeated rows are repeated; an empty table gives no rows.
    """
    all_versions = versions(docs)
    known = None
    if ledger_path:
        where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.schema(_LEDGER).parquet(ledger_path)
    fresh = scan_new(all_versions.select("sha", "text"), known, rules)
    if ledger_path:
        fresh.write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(_LEDGER).parquet(ledger_path)
    else:
        ledger = scratch.write(spark, fresh, "ledger")
    order = F.struct("start", "rank", "kind", "end")
    spans = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    by_sha = findings(ledger, rules).groupBy("sha").agg(spans.alias("spans"))
    return _with_spans(spark, all_versions.select("doc_id", "sha"), by_sha)


def _with_spans(spark: SparkSession, rows: DataFrame, by_sha: DataFrame) -> DataFrame:
    """rows (doc_id, sha) with the spans of their content.

    Contents of many versions, the empty text among them, are few and are broadcast with what was found in them;
    their versions then go through the join each under a key of its own that meets nothing, the same one in every try of a task.
    """
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    hot = rows.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("sha").join(by_sha, "sha", "left")
    hot = scratch.write(spark, hot.select("sha", F.coalesce("spans", none).alias("hot")), "hot")
    small = (hot.agg(F.sum(1 + F.size("hot"))).first()[0] or 0) <= BROADCAST_SPANS
    rows = rows.join(F.broadcast(hot) if small else hot, "sha", "left")
    alone = F.concat(F.lit("row "), F.xxhash64("doc_id", "sha").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(alone))
    return rows.join(by_sha.withColumnRenamed("sha", "key"), "key", "left").select("doc_id", "sha", F.coalesce("hot", "spans", none).alias("spans"))


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The counts and digests of base spans, and the list of all."""
    mine = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in base]))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in base], F.sha2(joined(mine), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows with every span of the text replaced; rows are matched by doc_id, null or not, and content."""
    by = scanned.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("spans").alias("_spans")).filter(F.size("_spans") > 0).dropDuplicates(["_id", "_sha"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(text, 256) == F.col("_sha")), "left")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(F.concat(s["out"], gap).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text")))

    clean = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate("_spans", state, step, finish))
    return joined.select(*[clean.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _sql_kind(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    return f"""
      SELECT doc_id, '{kind}' AS kind, {rank} AS rank, m.s AS s, m.e AS e FROM (
        SELECT doc_id, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
            s := coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0),
            e := coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0),
            n := length(ks[i]))), lambda x: x.n >= {least})) AS m
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gs, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS ks FROM d WHERE regexp_matches(t, '{pattern}')))"""


_KINDS = " UNION ALL ".join(_sql_kind(r.kind, r.pattern.replace("'", "''"), r.group, r.least, i) for i, r in enumerate(BASE))
_LIST = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank)"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_KINDS}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, {_LIST} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
