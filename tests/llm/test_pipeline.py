import random
import re

import corpus_pipeline
from citewell.llm import components, scratch, secret_ledger
from tests.llm.fixtures import SCHEMA, frame, prose, texts


def table(spark, path, rows, columns, name):
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/{name}.parquet")


def setup(spark, path, rows, items, labels):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    table(spark, path, items, "item_id long, text string", "benchmark")
    table(spark, path, labels, "doc_id long, quality int, toxic int", "labels")
    return str(path)


def test_stages_catch_what_is_planted(spark, tmp_path):
    rng = random.Random(12)
    clean = [(i, prose(rng, 80)) for i in range(600)]
    toxic = [(i, prose(rng, 60) + " you worthless scum, scum") for i in range(1000, 1200)]
    copies = [(2000 + i, clean[i][1] + " more words") for i in range(20)]
    item = prose(rng, 40)
    dirty = [(3000 + i, prose(rng, 100) + " " + item) for i in range(10)]
    hidden = [(4000 + i, prose(rng, 50) + " password=abcdef123456 " + prose(rng, 5)) for i in range(10)]
    labels = [(i, 1, 0) for i, _ in clean[:400]] + [(i, 1, 1) for i, _ in toxic[:150]]
    path = setup(spark, tmp_path, clean + toxic + copies + dirty + hidden, [(1, item)], labels)
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        assert k == 4 or docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    left = {i for i, _ in clean}
    assert kept[0] == left | {i for i, _ in copies + dirty + hidden}
    assert kept[1] == left | {i for i, _ in dirty + hidden}
    assert kept[2] == kept[3] == left | {i for i, _ in hidden}
    redacted = spark.read.parquet(f"{path}/out-secrets")
    assert redacted.filter("doc_id >= 4000 and text like '%[secret]%'").count() == 10
    assert not [r for r in redacted.collect() if re.search("password=", r.text)]
    assert secret_ledger.scan(spark, redacted).filter("size(spans) > 0").count() == 0
    assert kept[4] == kept[3]


def test_rows_without_an_id_are_cleaned(spark, tmp_path):
    rng = random.Random(13)
    clean = [(i, prose(rng, 80)) for i in range(200)]
    toxic = [(i, prose(rng, 60) + " you worthless scum, scum") for i in range(1000, 1060)]
    item, lone = prose(rng, 40), prose(rng, 80)
    bad = {name: prose(rng, 60) + end for name, end in (("toxic", " you worthless scum, scum"), ("dirty", " " + item))}
    hidden = prose(rng, 50) + " password=abcdef123456"
    rows = clean + toxic + [(None, t) for t in (*bad.values(), hidden, clean[3][1] + " more words", clean[4][1], lone, lone + " more words", None)]
    path = setup(spark, tmp_path, rows, [(1, item)], [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic])
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        left.append({r.text for r in docs.filter("doc_id is null").collect()})
    assert bad["toxic"] not in left[0] and bad["dirty"] in left[0] and hidden in left[0]
    assert len(left[1] & {lone, lone + " more words"}) == 1 and not left[1] & {clean[3][1] + " more words", clean[4][1]}
    assert bad["dirty"] not in left[2] and hidden in left[2]
    assert hidden not in left[3] and any(t and t.endswith("[secret]") for t in left[3])
    assert None in left[3] and {i for i, _ in clean} == {r.doc_id for r in docs.collect()} - {None}


def linked(a, b):
    sets = []
    for text in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_near_copies_under_repeated_ids(spark, tmp_path):
    """Each group of linked rows keeps one row, with its smallest id, whatever other rows have that id."""
    rng = random.Random(14)
    base = [prose(rng, 80) for _ in range(8)]
    copy = lambda k, end: f"{base[k]} {end}"
    rows = [(1, base[0]), (7, base[1]), (7, copy(0, "x")), (9, copy(1, "y")), (20, base[2]), (20, copy(2, "z")), (20, copy(2, "z")), (21, copy(2, "w"))]
    rows += [(30, base[3]), (31, base[4]), (31, copy(3, "v")), (29, copy(4, "u")), (None, None), (None, None), (40, None), (40, None), (40, ""), (None, copy(5, "t")), (50, base[5]), (50, base[6])]
    rows += [(3, copy(7, "a b")), (60, base[7]), (60, base[7]), (60, base[0])]
    path = setup(spark, tmp_path, rows, [(1, "x")], [(1, 1, 0)])
    found = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if linked(a, b):
                group = [group[j] if g == group[i] else g for g in group]
    assert len(found) == len(set(group))
    for g in set(group):
        members = [r for r, mine in zip(rows, group, strict=True) if mine == g]
        least = min((i for i, _ in members if i is not None), default=None)
        assert sum(r in found and r[0] == least for r in set(members)) == 1, members
        assert sum(found.count(r) for r in set(members)) == (1 if members[0][1] else rows.count(members[0])), members


def test_hard_rows_and_empty_tables(spark, tmp_path):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())] + [(3, "one"), (3, "one")]
    path = setup(spark, tmp_path / "a", rows, [(1, None), (None, "x")], [(1, None, None), (None, 1, 1)])
    assert corpus_pipeline.run(spark, path).count() > 0
    path = str(tmp_path / "b")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    table(spark, path, [], "item_id long, text string", "benchmark")
    table(spark, path, [], "doc_id long, quality int, toxic int", "labels")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_component_rounds_hold_no_step_twice(spark, monkeypatch):
    """Plans of a round stay small, whatever the round: the driver's memory goes with them."""
    plans, write = [], scratch.write
    monkeypatch.setattr(scratch, "write", lambda s, frame, name: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or write(s, frame, name))
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)
    assert len(plans) > 8 and all(p.count("Exchange hashpartitioning") <= 3 for p in plans)
