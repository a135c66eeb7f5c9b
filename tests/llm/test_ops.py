import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.llm import ann, blocks, chat, decontamination, hmm_lm, kernel, ngram_join, packing, queries, secret_ledger, substring_dedup, suffix_automaton, tokens, toxicity
from tests.llm.fixtures import documents, frame, prose, texts
from tests.oracle import same

LOW = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall(text or "")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001")


def test_kernel_words():
    import pyarrow as pa

    column = pa.array(texts())
    data, offsets = kernel.buffers(column)
    starts, ends, first = kernel.spans(data, offsets, kernel.NO_SPACE)
    mine = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    want = [w.encode() for t in texts() for w in words(t)]
    assert mine == want and list(np.diff(first)) == [len(words(t)) for t in texts()]
    named = dict(zip(mine, kernel.word_hashes(data, starts, ends, False).tolist(), strict=True))
    assert len(set(named.values())) == len(named)
    folded = kernel.word_hashes(data, starts, ends, True)
    assert len(set(folded.tolist())) == len({w.translate(LOW) for t in texts() for w in words(t)})
    assert kernel.buffers(column.slice(8, 2))[0].tobytes() == "".join(t or "" for t in texts()[8:10]).encode()


def test_delta_coding():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (blocks.expand(blocks.squeeze(values)) == values).all() and len(blocks.expand(blocks.squeeze(values[:0]))) == 0
    counts = np.array([1, 2, 1 << 40], np.uint64)
    assert (blocks.unpack_counts(blocks.pack_counts(counts)) == counts).all()


# 1 toxicity


def test_index_finds_the_exact_nearest():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        where = np.sort(rng.choice(30, rng.integers(1, 5), replace=False))
        vectors.append((where, toxicity.weights(rng.integers(1, 4, len(where)).astype(float), np.ones(30)[where])))
    dense = np.zeros((300, 30))
    for e, (where, w) in enumerate(vectors):
        dense[e, where] = w
    index = toxicity.BlockMaxIndex(vectors, 30)
    for e in range(0, 300, 7):
        got, cosine = index.nearest(*vectors[e], 10)
        all_of = dense @ dense[e]
        want = [i for i in np.lexsort((np.arange(300), -np.round(all_of, 12))) if all_of[i] > 0][:10]
        assert np.allclose(cosine, all_of[want]) and np.allclose(all_of[got], all_of[want])


def test_toxicity_examples_are_bounded(spark, monkeypatch):
    """One text of each labelled id, however many it has, and all words together within the bound."""
    rng = random.Random(6)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], prose(rng, 9)) for _ in range(200)] + [(i, prose(rng, 9)) for i in ids[1:]]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "EXAMPLES", 10)
    found = toxicity._examples(documents(spark, rows + [(ids[1], None)]), labels)
    assert found.count() == found.select("doc_id").distinct().count() == 10
    sizes = sorted((r.h, len(r.words)) for r in found.selectExpr("xxhash64(doc_id) as h", "words").collect())
    monkeypatch.setattr(toxicity, "POSTINGS", sum(n for _, n in sizes[:4]) + 1)
    assert sorted(r.h for r in toxicity._within(spark, found).selectExpr("xxhash64(doc_id) as h").collect()) == [h for h, _ in sizes[:4]]


def brute_scores(rows, labels):
    """Votes of the nearest examples by dense vectors, calibrated by pooling neighbours in order of their votes."""
    tokens_of = {}
    for i, (_, text) in enumerate(rows):
        tokens_of[i] = collections.Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOW)))
    train = [(i, labels[d]) for i, (d, _) in enumerate(rows) if d in labels and zlib.crc32(str(d).encode()) % 5]
    words_ = sorted({w for i, _ in train for w in tokens_of[i]})
    df = {w: sum(w in t for t in tokens_of.values()) for w in words_}
    n1, total = sum(t for _, t in train), len(train)
    telling = {}
    for w in words_:
        a, b = (sum(w in tokens_of[i] and t == k for i, t in train) for k in (1, 0))
        cells = [(a, a + b, n1), (b, a + b, total - n1), (n1 - a, total - a - b, n1), (total - n1 - b, total - a - b, total - n1)]
        telling[w] = 1 + max(0, 2 * sum(x * math.log(x * total / (r * c)) for x, r, c in cells if x))

    def vector(t):
        v = np.array([(1 + math.log(t[w])) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) * telling[w] if t[w] else 0.0 for w in words_])
        return v / np.linalg.norm(v) if v.any() else v

    known, toxic = np.array([vector(tokens_of[i]) for i, _ in train]), np.array([t for _, t in train], float)

    def vote(v, without=None):
        cosine = known @ v
        if without is not None:
            cosine[without] = 0
        near = [e for e in np.lexsort((np.arange(len(train)), -cosine)) if cosine[e] > 0][: toxicity.NEIGHBOURS]
        return toxicity._vote(cosine[near], toxic[near])

    steps = toxicity._isotonic(np.array([vote(known[e], e) for e in range(len(train))]), toxic)
    out = []
    for i in range(len(rows)):
        v = vector(tokens_of[i])
        out.append(steps[1][max(0, int(np.searchsorted(steps[0], vote(v), side="right")) - 1)] if v.any() else 0.05)
    return out


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 25) + (f" {rng.choice(['scum', 'moron', 'filth'])} {prose(rng, 4)}" if i % 3 == 0 else f" {rng.choice(['kind', 'scum' if i % 17 == 0 else 'good'])}")) for i in range(150)] + [(900, "zzz"), (901, None)]
    labels = {i: int(i % 3 == 0) for i in range(120)}
    frame_ = spark.createDataFrame([(i, t, t, "x") for i, t in labels.items()], "doc_id long, toxic int, text int, words string")
    got = {r.doc_id: r.score for r in toxicity.score(spark, documents(spark, rows), frame_).collect()}
    assert np.allclose([got[i] for i, _ in rows], brute_scores(rows, labels), atol=1e-5)


def test_toxicity_learns_and_leaves_clean_ones(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + (f" you {rng.choice(['scum', 'moron'])}, {rng.choice(['scum', 'moron'])}!" if i % 4 == 0 else "")) for i in range(900)]
    rows += [(900, None), (901, ""), (902, "SCUM"), (903, "scum"), (903, "scum")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(spark, documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 4 == 0 if r.doc_id < 900 else r.doc_id > 901), r
        assert bool(r.evidence) == bool(r.predicted)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(spark, documents(spark), labels).collect()} == {0}
    assert toxicity.score(spark, documents(spark, []), labels).count() == 0


def test_toxicity_compares_all_words_of_few_labels(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 12) + (" du mistkerl" if i % 5 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(45)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(spark, documents(spark, rows), labels).collect()}
    bags = [collections.Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(LOW))) for _, t in rows]
    known = [i for i in range(45) if zlib.crc32(str(i).encode()) % 5]
    names = sorted({w for i in known for w in bags[i]})
    n, tox = len(known), sum(i % 5 == 0 for i in known)

    def telling(w):
        both = [(sum(w in bags[i] for i in known if (i % 5 == 0) == t), tox if t else n - tox) for t in (True, False)]
        held = both[0][0] + both[1][0]
        cells = [(x, held, size) for x, size in both] + [(size - x, n - held, size) for x, size in both]
        return 1 + 2 * sum(x * np.log(x * n / (row * size)) for x, row, size in cells if x)

    weight = np.array([telling(w) * (np.log(91 / (1 + sum(w in b for b in bags))) + 1) for w in names])
    dense = np.array([[1 + np.log(b[w]) if b[w] else 0.0 for w in names] for b in bags]) * weight
    dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
    for i, r in got.items():
        want = sorted((dense[known] @ dense[i]).tolist(), reverse=True)[:3]
        assert np.allclose([x.cosine for x in r.nearest], want, atol=1e-5), r
        assert r.predicted == int(i % 5 == 0), r


# 2 packing, 5 token counts


def test_token_counts(spark):
    known = tokens.tokenizer(tokens.default_path())
    rows = list(enumerate(texts())) + [(500, "It's x'!, É. don't «a», b.., ÀÞ. İ ΣΑΣ Ａ. é <|ENDOFTEXT|>")]
    got = sorted(tokens.token_counts(spark, documents(spark, rows)).collect())
    want = [(i, len((t or "").encode()), n := len(known.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in rows]
    assert [tuple(r) for r in got] == want
    assert tokens.token_counts(spark, documents(spark, [])).count() == 0


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    monkeypatch.setattr(tokens, "LONGEST", 8)
    cache, known = tokens.PieceCache(tokens.default_path(), len), tokens.tokenizer(tokens.default_path())
    for t in texts() * 2:
        pieces = cache.split((t or "").encode())
        table = cache.table(pieces)
        assert sum(table[p] for p in pieces) == len(known.encode(t or "", add_special_tokens=False))


def test_packing_round_trip(spark):
    known = tokens.tokenizer(tokens.default_path())
    rows = list(enumerate(texts())) + [(7, "again"), (7, "again")]
    pieces = packing.pack(spark, documents(spark, rows).repartition(3)).collect()
    lines = collections.defaultdict(list)
    for p in pieces:
        lines[p.sequence_id].append((p.offset, p.length))
    for s, found in lines.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or s == max(lines)
    assert sorted(lines) == list(range(len(lines)))
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for i, t in rows:
        if i == 7:
            continue
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(by_doc[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(by_doc[7]) >= 3 and packing.pack(spark, documents(spark, [])).count() == 0


# 3 n-gram join


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_one_shingle_of_many_unlike_texts(spark):
    """Thousands of short texts that share eight of ten shingles are no links, and are not paired either."""
    rng = random.Random(21)
    common = "we kindly thank all of our readers for their many letters"  # 11 words
    rows = [(i, f"{common} {rng.getrandbits(40):x} {rng.getrandbits(40):x} {rng.getrandbits(40):x}") for i in range(3000)]
    rows += [(5000 + i, t + " again") for i, (_, t) in enumerate(rows[:30])]
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(spark, documents(spark, rows)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}


def test_near_components(spark):
    rng = random.Random(4)
    rows = list(enumerate(texts(5, 120)))
    group = prose(rng, 120).split(" ")
    for k in range(150):  # a group of near copies, some of them beyond the threshold of each other
        copy = list(group)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(copy)))
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, names)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark, documents(spark, rows).repartition(3)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in names}
    assert len(set(want.values())) < len(names) - 100
    assert ngram_join.near_components(spark, documents(spark, [])).count() == 0


# 4 nearest neighbours


def nearest(x, ids, q, k=20):
    """Brute force: (id, score) of the k best other rows, each id by its best row."""
    best = {}
    for i, v in zip(ids, x @ q[1], strict=True):
        if i != q[0]:
            best[i] = max(best.get(i, -np.inf), v)
    return sorted(best.items(), key=lambda f: (-round(f[1], 9), f[0]))[:k]


@pytest.mark.parametrize("per_list", [512, 25])
def test_nearest_neighbours(spark, per_list):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 24), (1060, [float("nan")] * 24), (1080, [None] * 24), (None, x[0].tolist())]
    got = collections.defaultdict(list)
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, list int, chunk int, score double")
    for r in ann.search(spark, table, per_list=per_list).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len({i for _, i, _ in found} & {i for i, _ in nearest(x, range(700), (q, x[q]))})
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(spark, few).orderBy("rank").collect()] == list(np.argsort(-(x[1:5] @ x[0])) + 1)
    assert ann.search(spark, few.limit(0)).count() == 0


def test_queries_come_in_blocks_and_a_task_hands_on_k_of_each(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(700, 24))
    written, write = [], ann.scratch.write
    monkeypatch.setattr(ann.scratch, "write", lambda s, frame, name: written.append((name, write(s, frame, name))) or written[-1][1])
    monkeypatch.setattr(ann, "QUERY_BYTES", 10 * 24 * 8, raising=False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(spark, table, per_list=5, probes=1.0).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    found = [frame for name, frame in written if name == "neighbours"]
    assert len(found) == 8  # two scans of each of four blocks
    for frame in found:
        assert (frame.groupBy("query_id", F.input_file_name()).count().agg(F.max("count")).first()[0] or 0) <= 20
    hit = sum(len({i for _, i in f} & {i for i, _ in nearest(x, range(700), (q, x[q]))}) for q, f in got.items())
    assert sorted(got) == list(range(0, 700, 20)) and hit / (20 * len(got)) >= 0.9


def test_nearest_of_repeats_and_odd_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    ids = [*range(60), *[17] * 30, *[20] * 3]
    held = np.vstack([x, np.tile(x[17], (30, 1)), np.tile(x[20], (3, 1))])
    rows = [(i, v.tolist()) for i, v in zip(ids, held, strict=True)] + [(200 + i, [1.0] * (7 if i % 2 else 9)) for i in range(20)]
    got = collections.defaultdict(list)
    for r in ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_list=5, probes=1.0).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert sorted(got) == [0, 20, 40]
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == [i for i, _ in nearest(held, ids, (q, x[q]))]


# 6 secrets

KINDS = [
    ("assign", re.compile(r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def secrets(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate(KINDS) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


SECRET_TEXTS = [
    "password: hunter2secret é API_KEY='abcdef123' 🙂 token=ab token = \"longenough\"", "AKIA" + "A1" * 9 + " AKIAshort " + "0123456789abcdef" * 3,
    "secret=token:abcdefgh passwd=deadbeefdeadbeefdeadbeefdeadbeef", "é🙂" * 50 + "token:" + "a" * 24, None, "", "nothing here", "token=" + "f" * 30 + "AKIA" + "B" * 16,
]


def test_secret_spans(spark):
    rows = [(i % 9, t) for i, t in enumerate(SECRET_TEXTS * 3)]
    got = secret_ledger.digest(secret_ledger.scan(spark, documents(spark, rows))).collect()
    want = []
    for i, t in rows:
        found = secrets(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append((i, *(sum(k == kind for k, _, _ in found) for kind in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(map(tuple, got)) == sorted(want)
    assert secret_ledger.scan(spark, documents(spark, [])).count() == 0


def test_secrets_of_hot_contents(spark, monkeypatch):
    """Versions of common contents, without ids too, find their spans by broadcast and by shuffle alike."""
    monkeypatch.setattr(secret_ledger, "HOT", 3)
    rows = [(i if i % 3 else None, SECRET_TEXTS[0 if i % 2 else 5]) for i in range(40)] + list(enumerate(SECRET_TEXTS))
    want = sorted(str((i, [(k, a, b) for k, a, b in secrets(t)])) for i, t in rows)
    for bound in (secret_ledger.BROADCAST_SPANS, 0):
        monkeypatch.setattr(secret_ledger, "BROADCAST_SPANS", bound)
        got = secret_ledger.scan(spark, documents(spark, rows)).collect()
        assert sorted(str((r.doc_id, [tuple(x) for x in r.spans])) for r in got) == want


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = secret_ledger.scan(spark, documents(spark, [(1, SECRET_TEXTS[0]), (2, SECRET_TEXTS[0])]), ledger_path=path).collect()
    assert spark.read.parquet(path).count() == 1 and first[0].spans == first[1].spans
    more = documents(spark, [(1, SECRET_TEXTS[0]), (3, SECRET_TEXTS[1])])
    secret_ledger.scan(spark, more, ledger_path=path).collect()
    assert spark.read.parquet(path).count() == 2
    newer = (*secret_ledger.BASE[:2], secret_ledger.Rule("hex", 2, "[0-9a-f]{40,}", 0, 40))
    again = secret_ledger.scan(spark, more, newer, path).collect()
    assert [r.scanned for r in spark.read.parquet(path).collect() if r.scanned == ["hex@2"]] == [["hex@2"]] * 2
    assert sum(len(r.spans) for r in again) == len(secrets(SECRET_TEXTS[0])) + len(secrets(SECRET_TEXTS[1]))


def test_redaction(spark):
    docs = documents(spark, list(enumerate(SECRET_TEXTS)))
    got = {r.doc_id: r.text for r in secret_ledger.redact(docs, secret_ledger.scan(spark, docs)).collect()}
    for i, t in enumerate(SECRET_TEXTS):
        out, at = "", 0
        for _, a, b in secrets(t):
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        assert got[i] == (t if t is None else out + t[at:])


# 7 decontamination


def test_contamination(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 13, 14, 5, 1, 20, 12, 2])] + [(50, None), (51, "... !"), (52, prose(rng, 3000)), (7, "another text of the same item")]
    rows = list(enumerate(texts(8, 30))) + [(i, t) for i in (-1, -7, 0, None) for t in (items[0][1], "x " + items[1][1], "clean words", None)]
    for k, (_, t) in enumerate(items):
        if t:
            w = t.split(" ")
            rows += [(1000 + 10 * k, prose(rng, 30) + " " + " ".join(w[:20]) + " " + prose(rng, 30)), (1001 + 10 * k, t.upper()), (1002 + 10 * k, " ".join(w[1:14]) + "\x00" + prose(rng, 3000) + " " + t)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = split(t)
        m = min(13, len(w))
        for j in range(len(w) - m + 1) if m else []:
            windows[tuple(w[j : j + m])].add(str(k))
    lengths = {len(w) for w in windows}
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for m in lengths:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j : j + m])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame([(k, t, "x", 1) for k, t in items], "item_id long, text string, hash string, pos int")
    for bound in (decontamination.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bound)
        got = decontamination.digest(decontamination.contamination(spark, documents(spark, rows), bench)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    none = decontamination.contamination(spark, documents(spark, rows), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    assert decontamination.contamination(spark, documents(spark, []), bench).count() == 0


# 8 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\<s>\\", "<<SYS>> \\\\\\[ROLE]", "", " ", "é🙂 日本", "[INST", "ST] x", None, "\n</s>\n"]
    rng, rows = random.Random(2), []
    for c in range(30):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None, "[INST]", "</s>"]), rng.choice(nasty)))
    rows += [(1, 1, "assistant", "same turn"), (None, 1, "user", "x"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(spark, table)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, (_, r), (_, x) in sorted(turns)]
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digest(chat.format_chats(spark, table.limit(0))).count() == 0


def test_masks_align_with_tokens(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general kenobi 🙂"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(spark, table).first()
    assert len(row.ids) == len(row.mask) and 0 < sum(row.mask) < len(row.mask)
    assert "".join(row.formatted[x.start : x.end] for x in row.loss) == "general kenobi 🙂"


# 9 repeats


def test_repeats_are_removed(spark):
    rows = list(enumerate(texts(6, 80))) + [(900, "a b " * 40), (901, "\u00a0".join(map(str, range(40)))), (902, " ".join(map(str, range(35)))), (903, " ".join(map(str, range(34))))]
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.digest(substring_dedup.remove_repeats(spark, documents(spark, rows).repartition(3))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(n for _, _, n, _ in want) > 1000
    assert substring_dedup.remove_repeats(spark, documents(spark, [])).count() == 0


# 10 language model


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    first, change, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.uniform(1e-6, 1e-3, (hmm_lm._SYMBOLS, 3))
    documents = [rng.integers(0, hmm_lm._SYMBOLS, n).astype("<u2") for n in (1, 2, 63, 64, 65, 128, 500, 3)]
    chunks = hmm_lm.Chunks(documents)
    _, logs = chunks.forward(*chunks.products(change, emit), first)
    firsts, moves, counts, total = hmm_lm.Chunks(documents).expected(first, change, emit)
    want_logs, want_moves, want_counts, want_firsts = [], np.zeros((3, 3)), np.zeros((3, hmm_lm._SYMBOLS)), np.zeros(3)
    for d in documents:
        alpha, scale = [first * emit[d[0]]], []
        for t in range(len(d)):
            if t:
                alpha.append((alpha[-1] @ change) * emit[d[t]])
            scale.append(alpha[-1].sum())
            alpha[-1] = alpha[-1] / scale[-1]
        want_logs.append(np.log(scale).sum())
        beta = np.ones(3)
        for t in reversed(range(len(d))):
            share = alpha[t] * beta
            want_counts[:, d[t]] += share / share.sum()
            if t == 0:
                want_firsts += share / share.sum()
            else:
                pair = alpha[t - 1][:, None] * change * (emit[d[t]] * beta)[None, :]
                want_moves += pair / pair.sum()
                beta = change @ (emit[d[t]] * beta)
                beta /= beta.sum()
    assert np.allclose(logs, want_logs) and abs(total - sum(want_logs)) < 1e-6
    assert np.allclose(moves, want_moves) and np.allclose(counts, want_counts) and np.allclose(firsts, want_firsts)


def test_lm_counts_and_gain(spark):
    rng = random.Random(3)
    left, right = [prose(rng, 1).strip() + "l" for _ in range(60)], [prose(rng, 1).strip() + "r" for _ in range(60)]
    rows = list(enumerate(texts(7, 40))) + [(1000 + i, " ".join(rng.choice(left if i % 2 else right) for _ in range(150))) for i in range(80)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    bags = {i: [*words((t or "").translate(LOW)), None] for i, t in rows}
    count = collections.Counter(w for i, b in bags.items() if not held[i] for w in b)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in hmm_lm.score(spark, documents(spark, rows).repartition(3)).collect()}
    for i, b in bags.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in b)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(b), sum(count[w] > 0 for w in b), n)
        assert abs(got[i].base_score - base) < 1e-6 * abs(base) and math.isfinite(got[i].score)
    mixed = [got[i] for i in got if i >= 1000 and held[i]]
    assert mixed and sum(r.score for r in mixed) > sum(r.base_score for r in mixed)
    assert hmm_lm.score(spark, documents(spark, [])).count() == 0


def test_lm_is_a_distribution(spark, monkeypatch):
    """Known words, the end and the unknown word have a probability of 1 together in each state; scores are the forward sums."""
    kept, train = [], hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    rows = [(k, f"a b{k % 3} c" + " new" * (zlib.crc32(str(k).encode()) % 7 == 2)) for k in range(40)] + [(50, None), (51, "a " * 200)]
    got = {r.doc_id: r.score for r in hmm_lm.score(spark, frame(spark, rows)).collect()}
    first, change, emit, _ = kept[0]
    assert np.allclose(emit.sum(axis=0), 1) and np.allclose(change.sum(axis=1), 1) and abs(first.sum() - 1) < 1e-9
    known = sorted({w for i, t in rows for w in words(t) if zlib.crc32(str(i).encode()) % 7 != 2})
    raw, ends = np.frombuffer("".join(known).encode(), np.uint8), np.cumsum([len(w) for w in known])
    hashes = kernel.word_hashes(raw, ends - [len(w) for w in known], ends, True)
    place = dict(zip(known, np.argsort(np.argsort(hashes)).tolist(), strict=True))
    for i, t in rows:
        state, total = first, 0.0
        for k, symbol in enumerate([*(place.get(w, hmm_lm._UNKNOWN) for w in words(t)), hmm_lm._ENDED]):
            state = (state @ change if k else state) * emit[symbol]
            total += math.log10(state.sum())
            state = state / state.sum()
        assert abs(got[i] - total) < 1e-6 * abs(total), (i, t)


def test_lm_of_texts_unlike_the_training_ones(spark):
    """Held-out texts that mix what training texts keep apart, or have their words in another order, score nearly the base model's score or more."""
    rng = random.Random(5)
    left, right = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    copy = [rng.choice(left) for _ in range(400)]
    other = rng.sample(copy, len(copy))
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    mixed = [(k, " ".join(rng.choice(left + right if held(k) else right if k % 2 else left) for _ in range(200))) for k in range(200)]
    copies = [(k, " ".join(other if held(k) else copy)) for k in range(200)]
    for rows in (mixed, copies):
        got = [r for r in hmm_lm.score(spark, frame(spark, rows)).collect() if r.held_out]
        assert got and all(r.score > r.base_score + math.log10(0.5) + r.n_tokens * math.log10(0.999) - 1e-6 for r in got)


def test_lm_weights_of_rare_words(spark, monkeypatch):
    """Rare words share their last byte's symbol by count plus one: in the base state they have the base model's probability."""
    kept, train = [], hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    rng = random.Random(6)
    rows = [(k, "the " * 400 + " ".join(f"r{rng.randrange(900)}" for _ in range(6))) for k in range(200)]
    bag = collections.Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*words(t), None])
    n, v = sum(bag.values()), len(bag)
    hmm_lm.score(spark, frame(spark, rows)).collect()
    _, _, emit, weights = kept[0]
    rare = {w: c for w, c in bag.items() if c * hmm_lm.FREQUENT < n}
    assert len(rare) > 300 and max(rare.values()) > 1
    for last in "0123456789":
        want = sum(c + 1 for w, c in rare.items() if w.endswith(last))
        at = hmm_lm._RARE + ord(last)
        assert weights[at] == want and abs(emit[at, -1] - want / (n + v + 1)) < 1e-12
    assert abs(weights.sum() - n - v) < 1e-6


def test_lm_without_training_rows(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, t) for k, t in zip(held, ["a b", "", None], strict=False)]
    assert {(r.base_score, round(r.score, 9), r.n_known, r.train_tokens) for r in hmm_lm.score(spark, frame(spark, rows)).collect()} == {(0.0, 0.0, 0, 0)}


def test_matching_statistics():
    rng = random.Random(8)
    parts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))] for _ in range(6)]
    runs = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    probe = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)]
    got = list(suffix_automaton.SuffixAutomaton(parts).lengths(probe))
    want = [max((n for n in range(1, i + 2) if tuple(probe[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(probe))]
    assert got == want


def test_reference_spans_are_removed(spark):
    rng = random.Random(11)
    reference = [prose(rng, 300), None, "", prose(rng, 700), "short one"]
    rows = list(enumerate(texts(6, 20))) + [(500, prose(rng, 20) + " " + " ".join(words(reference[3])[80:200]) + " end"), (501, reference[0]), (501, reference[0]), (None, reference[0]), (502, " ".join(words(reference[0])[:34]))]
    windows = {tuple(words(t)[j : j + 35]) for t in reference for j in range(len(words(t)) - 34)}
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k for j in range(len(w) - 34) if tuple(w[j : j + 35]) in windows for k in range(j, j + 35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    table = spark.createDataFrame([(t, 1) for t in reference], "text string, part int")
    got = suffix_automaton.remove_reference_spans(spark, documents(spark, rows), table, shard=200).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix_automaton.remove_reference_spans(spark, documents(spark, rows), table.limit(0)).agg({"n_removed": "sum"}).first()[0] == 0
