from pyspark.sql import functions as F

from citewell.operators import patches, retrieval
from citewell.plans import catalog as C

HEADS = {
    "---\ntitle: \"A: b\"\naliases: ['x', \"y\"]\n\nodd\ntitle: last\n---\nbody: no": (None, {"title": "last", "aliases": "['x', \"y\"]"}, ["odd"]),
    " --- \r\nk:'v'\r\n ---": (None, {"k": "v"}, []),
    "---\na: 1\n": ("not closed", {"a": "1"}, []),
    "x\n---\na: 1\n---": ("missing", {}, []),
    "": ("missing", {}, []),
    "---\n---": (None, {}, []),
    "---\n: v\nk:\nq: '\n---": (None, {"": "v", "k": "", "q": "'"}, []),
}


def test_heads(spark):
    rows = spark.createDataFrame([(c,) for c in HEADS] + [(None,)], "content string").select("content", patches.head(F.col("content")).alias("h")).collect()
    got = {r.content: (r.h.state, {x.key: x.value for x in r.h.fields}, r.h.odd) for r in rows}
    assert got == HEADS | {None: ("missing", {}, [])}


def test_list_literals(spark):
    wanted = {"[]": [], "['a', \"b'c\",]": ["a", "b'c"], "[1, -2.5, True]": ["1", "-2.5", "True"], "['a\\'b']": ["a'b"], "[": None, "a, b": None, "['a' 'b']": None, "['a',,]": None, "": None, "['a\nb']": ["a\nb"]}
    rows = spark.createDataFrame([(v,) for v in wanted], "v string").select("v", patches.list_value(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == wanted


def test_all_faults_are_listed(spark):
    claims = spark.createDataFrame([("c1", "s", "t", "line:1", "cited", "t"), ("c2", "s", "t", "", "cited", "t")], C.schema("claims"))
    body = "\n".join(f"## {s}" for s in patches.PAGE_SECTIONS["source"])
    good = "---\npage_type: source\ntitle: T\naliases: ['a']\nsource_count: 1\nclaim_ids: ['c1']\nupdated_at: now\n---\n" + body
    rows = [
        ("good", "upsert_page", "source", "wiki/sources/a.md", good, ["c1"]),
        ("bad", "delete", "concept", "wiki/../a.txt", good.replace("['a']", "a").replace("updated_at: now", "odd").replace("## Links", "# Links"), ["c2", "c3"]),
        ("none", None, None, None, None, None),
        ("log", "upsert_page", "source", "wiki/log.md", good, []),
    ]
    found = {}
    for r in patches.patch_faults(spark.createDataFrame(rows, "page_id string, action string, page_type string, target_path string, content string, claim_ids array<string>"), claims).collect():
        found.setdefault(r.page_id, set()).add(r.fault)
    assert found == {
        "bad": {"unknown action", "target outside wiki", "target is not Markdown", "aliases is no list", "head line odd", "no field updated_at", "page types differ", "no section Links", "weak claim c2", "unknown claim c3", "no cited claims"},
        "none": {"unknown action", "no target", "head missing", "no claims"},
        "log": {"target is the log", "no claims"},
    }


def test_arrivals_replace_or_add(spark):
    kind = "query_id int, claim_id string, source_id string, page_id string, raw_score double, reasons array<string>, retriever string"
    lists = [[(1, "c", "s", "p1", 0.5, ["like"], "r"), (1, "d", "s", "p1", 1.0, ["like"], "r")], [(1, "c", "s", "p2", 0.9, ["full"], "r"), (1, "d", "s", "p2", 1.0, ["full"], "r")], [(1, "c", "s", "p3", 0.9, ["full", "span"], "r"), (1, "e", "s", "p3", 0.1, [], "r")]]
    rows = retrieval.merged(*[spark.createDataFrame(x, kind) for x in lists]).collect()
    assert {r.claim_id: (r.page_id, r.raw_score, r.reasons) for r in rows} == {"c": ("p2", 0.9, ["full", "span"]), "d": ("p1", 1.0, ["like", "full"]), "e": ("p3", 0.1, [])}
