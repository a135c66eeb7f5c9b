import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from citewell.llm import tile_dedup, turn_repair, turn_trie

CHATS = "conv_id long, turn long, role string, text string, cost long, audit string, key string, n long, times long, node string"


def chats(spark, rows):
    """conversations with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "k", 2, 3, "n") for r in rows], CHATS)


def some_chats(seed=5, n=120):
    rng = random.Random(seed)
    roles, said = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "No!", "ok", "", " \n", None, "Why?\t", "ünï 🙂.", "x" * 3000]
    rows = []
    for conv in range(n):
        at = rng.randrange(-3, 3)
        for i in range(rng.choice([1, 2, 3, 4, 6, 8])):
            role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][i % 2]
            rows.append((conv * 7 if conv % 9 else conv // 9 * 100, at, role, rng.choice(said)))
            at += rng.choice([0, 1, 1, 1, 3])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (-5, None, "user", "a."), (-5, None, "user", "a."), (-5, 0, "assistant", "b.")]
    rows += [(5000, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(60)]
    return rows + rows[:4]


def key(x):
    return (x is not None, x if x is not None else 0)


# 11 conversation repair


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def cheapest(turns):
    """Least (cost, audit, repaired) over all edits, by trying every one of them from the front."""

    @functools.cache
    def rest(at, state, free):
        found = []
        if at == len(turns) and state in (0, 3):
            found.append((0, "", ()))
        if free:
            role = ["user", "user", "assistant", "user"][state]
            c, a, r = rest(at, [2, 2, 3, 2][state], free - 1)
            found.append((c + 2, "I" + a, ((role, ""), *r)))
        if at < len(turns):
            role, text, fault = turns[at]
            c, a, r = rest(at + 1, state, 3)
            found.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                new = ["user", "user", "assistant", "user"][state]
                c, a, r = rest(at + 1, [2, 2, 3, 2][state], 3)
                found.append((c + 2 + more, "R" + a, ((new, text), *r)))
                to = {"s0": 1, "u0": 2, "u1": 2, "u3": 2, "a2": 3}.get(f"{role[:1]}{state}")
                if to:
                    c, a, r = rest(at + 1, to, 3)
                    found.append((c + more, "K" + a, ((role, text), *r)))
        return min(found, default=(10**9, "", ()))

    return rest(0, 0, 3)


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r, x) for c, t, r, x in damaged(rows) if c == conv), key=lambda r: (key(r[0]), *r[1:]))
        seen, turns, count = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        for _, role, text in mine:
            full = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                count[fault] += 1
        known = [t for t, _, _ in mine if t is not None]
        cost, audit, repaired = cheapest(tuple(turns))
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *count.values(), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def repaired(spark, rows):
    found = turn_repair.digest(*turn_repair.repair(spark, turn_repair.damaged(chats(spark, rows)))).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


@pytest.mark.parametrize("stretch", [512, 3])
def test_repair_equals_brute_force(spark, monkeypatch, stretch):
    """Also with conversations cut into stretches of three turns."""
    monkeypatch.setattr(turn_repair, "STRETCH", stretch)
    rows = some_chats()
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_of_every_short_pattern():
    for n in range(5):
        for turns in itertools.product(["s.", "u.", "ut", "a.", "ax", "-.", "-t"], repeat=n):
            codes, wanted = "".join(turns), cheapest(tuple((c[0], str(i), {"t": "truncated", "x": "blank", ".": ""}[c[1]]) for i, c in enumerate(turns)))
            assert turn_repair.joined([turn_repair.stretch(codes)]) == wanted[:2]
            halves = [turn_repair.stretch(codes[: n // 2 * 2]), turn_repair.stretch(codes[n // 2 * 2 :])]
            assert turn_repair.joined(halves) == wanted[:2]


def test_weights_order_like_audits():
    paths = [(c, "".join(a)) for c in range(3) for n in range(4) for a in itertools.product("DIKR", repeat=n)]
    weights = [turn_repair.put_in_front(0, c, a, 5) for c, a in paths]
    assert [p for _, p in sorted(zip(weights, paths, strict=True))] == sorted(paths)
    assert [turn_repair.path(w, 5) for w in weights] == paths


def test_repair_without_rows(spark):
    assert repaired(spark, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(lost, 0, "user", "x")])[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# 12 conversation prefix trie


def brute_trie(rows):
    own = {}
    for c in {r[0] for r in rows}:
        own[c] = [(r, t) for _, r, t in sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda r: (key(r[0]), *r[1:]))]
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str("" if c is None else c).encode()) % 6
        base = None if c is None else c - int(np.fmod(c, 100))
        full = (own.get(base, [])[:h] if c is not None else []) + turns[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append((c, d == len(full)))
    least = lambda path: min((c for c, _ in nodes[path] if c is not None), default=None)
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c, e in members if e and c is not None)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(members), kids[p], sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("segment", "ids"), [(4_000_000, 64_000), (200, 20), (1, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, ids):
    """Also with trees of a few conversations and of one, so that most nodes are added up from several."""
    monkeypatch.setattr(turn_trie, "SEGMENT", segment)
    monkeypatch.setattr(turn_trie, "IDS", ids)
    rows = some_chats()
    rows += [(c, t, r, x) for c in range(6001, 6060) for t, (r, x) in enumerate([("user", "same"), ("assistant", f"a{c % 3}"), ("user", "end")])]
    found = turn_trie.prefix_trie(spark, chats(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert turn_trie.prefix_trie(spark, chats(spark, [])).count() == 0


def test_radix_tree_layouts():
    tree, rng = turn_trie.RadixTree(), random.Random(1)
    keys = sorted({bytes(rng.choices(range(256), k=rng.choice([1, 1, 2, 2, 5, 40]))) for _ in range(4000)} | {b"", b"\0", b"\0\0"})
    seen = set()
    for i, k in enumerate(keys):
        tree.add(k, 1, i)
        seen.add(tree.root.layout())

    def walk(node, prefix):
        full = prefix + node.path
        if node.times:
            yield full, node.least
        assert all(node.child((k.path[0])) is k for k in node.children())
        for kid in node.children():
            yield from walk(kid, full)

    assert list(walk(tree.root, b"")) == [(k, i) for i, k in enumerate(keys)] and seen == {4, 16, 48, 256}


# 13 near-duplicate vectors


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, "t", 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, n long, class string, tile long")


def brute_vectors(rows):
    good = [(n, np.array(v, float)) for n, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    units = {n: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for n, v in good}
    links = {n: {m for m in units if m != n and len(units[m]) == len(x) and x @ units[m] >= 0.9} for n, x in units.items()}
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(links.get(n, ())), least, i is not None and i == least))
    return sorted(out, key=repr)


def some_vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        centre = rng.normal(size=24)
        rows += [(len(rows) + k, (centre + rng.normal(size=24) * s).astype(np.float32).tolist()) for k, s in enumerate([0, 0, 0.1, 0.3, 0.45, 0.5, 0.6][: 1 + c % 7])]
    rows += [(2000 + i, rows[8][1]) for i in range(30)]  # copies
    rows += [(i, v) for i, v in rows[:3]] + [(None, rows[9][1]), (None, None), (900, None), (901, []), (902, [0.0] * 24), (903, [1.0, None]), (904, [float("nan")] * 24), (905, [float("inf"), 1.0])]
    return rows + [(906, [1.0, 0.0]), (907, [2.0, -0.0]), (908, [-1.0, 0.0]), (909, [1e-30, 0.0]), (910, [3e38, 1.0])]


@pytest.mark.parametrize(("kind", "tile", "rows_at_once", "slab"), [("float", 4096, 512, 1024), ("double", 20, 3, 7)])
def test_vectors_equal_brute_force(spark, monkeypatch, kind, tile, rows_at_once, slab):
    monkeypatch.setattr(tile_dedup, "TILE", tile)
    monkeypatch.setattr(tile_dedup, "ROWS", rows_at_once)
    monkeypatch.setattr(tile_dedup, "SLAB", slab)
    rows = some_vectors()
    assert sorted(map(tuple, tile_dedup.near_vectors(spark, vectors(spark, rows, kind)).collect()), key=repr) == brute_vectors(rows)
    assert tile_dedup.near_vectors(spark, vectors(spark, [], kind)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-300, 1.0, 1e300):
        x = tile_dedup.unit(rng.normal(size=(200, 70)) ** 3 * scale)
        q, s, size, rest = tile_dedup.quantised(x)
        apart = np.abs(x @ x.T - tile_dedup._products(q, q) * s[:, None] * s)
        bound = size[:, None] * rest + rest[:, None]
        assert (apart <= bound + tile_dedup.SLACK).all() and bound.max() < 0.1
