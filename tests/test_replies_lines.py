"""Replies that are parsed and settled, prompts, and JSON lines read in ranges of bytes."""

import json

from citewell.operators import replies
from citewell.sources import documents as D

CONTEXTS = "answer_id string, claim_id string, source_id string, citation_locator string, page_path string"


def answer(**more):
    return json.dumps({"short_answer": "s", "citations": [{"claim_id": "c1", "source_id": "src", "citation_locator": "line:1"}]} | more)


def test_replies_are_settled_by_their_first_problem(spark):
    cite = lambda **more: {"claim_id": "c1", "source_id": "src", "citation_locator": "line:1"} | more
    cases = {
        "good": (answer(analysis=None, uncertainties=["a", " ", 3], suggested_title="T"), None, "answered", None),
        "repaired": ("Sure: {}", answer(), "answered", None),
        "twice": ("{", "[1]", "llm_failed", "no object"),
        "unrepaired": ('"text"', answer(), "llm_failed", "no object"),
        "null": (None, "", "llm_failed", "not JSON"),
        "object": (answer(citations={"claim_id": "c1"}), answer(), "llm_failed", "citations are no list"),
        "missing": (json.dumps({"short_answer": "s"}), answer(), "llm_failed", "citations are no list"),
        "empty": (answer(citations=[]), None, "invalid_citations", "nothing cited"),
        "bare": (answer(citations=["c1"]), None, "invalid_citations", "citation is no object"),
        "first": (answer(citations=[cite(), cite(claim_id="c9"), cite(source_id="x")]), None, "invalid_citations", "claim outside the evidence c9"),
        "source": (answer(citations=[cite(source_id=None)]), None, "invalid_citations", "other source of c1"),
        "locator": (answer(citations=[cite(citation_locator=1)]), None, "invalid_citations", "other locator of c1"),
    }
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in cases.items()], "answer_id string, reply string, repair string")
    contexts = spark.createDataFrame([(k, "c1", "src", "line:1", "p") for k in cases], CONTEXTS)
    got = {r.answer_id: r for r in replies.settled(rows, contexts.unionByName(contexts)).collect()}
    assert {k: (r.status, r.warning) for k, r in got.items()} == {k: (c[2], c[3]) for k, c in cases.items()}
    assert [k for k, r in got.items() if r.repaired] == [k for k in got if k in ("repaired", "twice", "null")]
    good = got["good"]
    assert (good.answer, good.analysis, good.title, good.uncertainties, good.conflicts) == ("s", "", "T", ["a", "3"], [])
    assert [tuple(c) for c in good.citations] == [("c1", "src", "line:1", "p")] and got["first"].citations is None
    assert replies.settled(rows.limit(0), contexts).count() == 0


def test_prompts_hold_the_evidence(spark):
    rows = spark.createDataFrame([("a", 'Why "x"?', [("c1", None)], None, ["w"])], "answer_id string, question string, contexts array<struct<claim_id:string,score:double>>, relationships array<string>, warnings array<string>")
    row = replies.prompts(rows).first()
    text = row.messages[1].content
    assert json.loads(text.split("Retrieved evidence:\n")[1]) == {"contexts": [{"claim_id": "c1", "score": None}], "relationships": [], "warnings": ["w"]}
    assert [m.role for m in row.repair] == ["system", "user", "user"] and row.repair[:2] == row.messages and 'Why "x"?' in text


def test_lines_of_a_split_file_keep_their_numbers(spark, tmp_path):
    lines = [json.dumps({"id": f"é{i}" * (i % 7)}, ensure_ascii=False) for i in range(400)]
    for i in range(0, 400, 37):
        lines[i] = ("", " ", "{broken", "[]")[i % 4]
    (tmp_path / "in").mkdir()
    for name, part in (("a.jsonl", lines), ("b.jsonl", lines[:3]), ("c.jsonl", [])):
        (tmp_path / "in" / name).write_text("\n".join(part) + "\n" * bool(part))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert D.numbered_lines(spark, str(tmp_path / "in" / "a.jsonl")).select("line", "value").orderBy("line").collect() == [(i + 1, x) for i, x in enumerate(lines)]
        assert spark.read.text(str(tmp_path / "in" / "a.jsonl")).rdd.getNumPartitions() > 5
        rows = D.read_json_lines(spark, str(tmp_path / "in"), "id string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wanted = []
    for name, part in (("a.jsonl", lines), ("b.jsonl", lines[:3])):
        for i, x in enumerate(part, 1):
            if x.strip():
                good = x.startswith('{"')
                wanted.append((name, i, json.loads(x)["id"] if good else None, None if good else f"{name}:{i}: not JSON"))
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.id, r.error) for r in rows if r.error or r.id is not None) == sorted(w for w in wanted if w[3] or w[2] is not None)


def test_staged_runs_come_back(spark, tmp_path):
    text = 'a "quoted"\nline \\ with\ttabs'
    claims = spark.createDataFrame([("r1", "c1", "s1", text, "line:1", "cited", None), ("r2", "c2", "s2", None, "", "weak", "t")], D.STAGED["claims"])
    patches = spark.createDataFrame([("r1", "upsert_page", "p", "source", "T", "wiki/p.md", text, ["c1"])], D.STAGED["patches"])
    D.write_staged({"claims": claims, "patches": patches, "manifests": spark.createDataFrame([], D.STAGED["manifests"])}, str(tmp_path / "run"))
    back = D.read_staged(spark, str(tmp_path / "run"))
    for name, was in (("claims", claims), ("patches", patches)):
        assert back[name].filter("error IS NULL").select(was.columns).orderBy("run_id").collect() == was.orderBy("run_id").collect()
    assert back["manifests"].count() == 0
