"""Prefix trie, suffix-tree scoring and resampling against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import exchange, prefix_trie, resample, suffix_tree_lm, textkit

CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, depth int, at int"


def conversations(seed):
    r = random.Random(seed)
    said = [None, "", "a", "b", "é中", "long " * 30]
    rows = []
    for c in [0, 3, 7, 100, 101, 105, 199, 205, 300, 301, -5, 12, 13, 14]:
        for t in range(r.randint(0, 7)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(said)))
    rows += [(400 + i, t, "user", "same") for i in range(600) for t in range(2)]  # one conversation many times
    rows += [(9000, t, "user", f"t{t % 3}") for t in range(900)] + [(None, 0, "user", "nobody")]
    rows += rows[:3]
    r.shuffle(rows)
    return rows


def rebuilt(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[: h[c]] + own[c][h[c] :] for c in own}


@pytest.mark.parametrize("seed", [0, 1])
def test_trie(spark, seed, tmp_path):
    rows = conversations(seed)
    whole = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    want = []
    leaves, saved, children = Counter(), Counter(), Counter(p[:-1] for p in members if p)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    for p, cs in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        want.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha))
    spark.createDataFrame([(*r, "x", 5, 6) for r in rows], CONVERSATIONS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_trie_of_nothing_and_hot_parents(spark, monkeypatch):
    given = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(given), F.lit(0), F.col("conv_id"))).count() == 0
    rows = spark.createDataFrame([(i, t, "user", f"{i if t else i % 2}") for i in range(400) for t in range(2)], "conv_id long, turn long, role string, text string")
    own = prefix_trie.turns(rows)
    usual = sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(own, F.lit(0), F.col("conv_id"))).collect()))
    monkeypatch.setattr(prefix_trie, "HOT", 1)
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(own, F.lit(0), F.col("conv_id"))).collect())) == usual and len(usual) == 403


def docs(seed, n=150):
    r = random.Random(seed)
    word = [f"w{i}" for i in range(30)] + ["É", "naïve", "x" * 300]
    out = []
    for i in range(n):
        out.append((i, r.choice([" ", "  ", "\n", ", "]).join(r.choice(word[: 5 + i % 28]) for _ in range(r.choice([0, 1, 3, 25, 60])))))
    out += [(500, None), (501, ""), (502, " \n"), (503, "The THE the " * 5000), (None, out[7][1]), out[9], out[9], (out[9][0], "another text")]
    r.shuffle(out)
    return out


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], f"{key} long, text string, id string, n long, part int").repartition(4)


LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.mark.parametrize("n,buckets", [(1, 10000), (2, 97), (3, 70000)])
def test_resample(spark, n, buckets):
    rows, items = docs(n), [(1, "w1 w2 The end"), (2, None), (None, "w3, W3!"), (3, "")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]

    s, t = (Counter(b for _, x in given for b in features(x)) for given in (rows, items))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    scored = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(x)
        w = sum(map(gain, f))
        scored.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    fit = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = [(*x[:4], k + 1 if k < 30 * len(fit) // 100 else None) for k, x in enumerate(fit)]
    want = drawn + [(*x[:4], None) for x in scored if x[4] < 20]
    got = resample.resample(frame(spark, rows), frame(spark, items, "item_id"), n, buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and any(x[4] for x in drawn)


def test_resample_of_nothing(spark):
    some, none = frame(spark, [(1, "a b " * 30)]), frame(spark, [])
    assert resample.resample(none, some, target_id="doc_id").count() == 0
    assert [tuple(r) for r in resample.resample(some, none, target_id="doc_id", percent=100).select("n_features", "rank").collect()] == [(60, 1)]


def brute_scores(rows, depth, least, gain):
    seqs = [(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]) for i, t in rows]
    count = defaultdict(Counter)  # context -> next tokens
    for _, held, w in seqs:
        if not held:
            h = ["<s>", *w]
            for j in range(1, len(h)):
                for k in range(min(depth, j) + 1):
                    count[tuple(h[j - k : j])][h[j]] += 1
    N, V = sum(count[()].values()), len(count[()])
    states = {}

    def p(ctx, w):
        out = (count[()][w] + 0.1) / (N + 0.1 * (V + 1))
        for k in range(1, len(ctx) + 1):
            s = ctx[len(ctx) - k :]
            if s in states:
                n, t = states[s]
                out = (count[s][w] + t * out) / (n + t)
        return out

    for k in range(1, depth + 1):
        new = {}
        for s in [s for s in count if len(s) == k]:
            n, t = sum(count[s].values()), len(count[s])
            if n >= least and sum(c * round(65536 * math.log(c / (n * p(s[1:], w)))) for w, c in count[s].items()) >= gain * 65536 * t:
                new[s] = (n, t)
        states |= new
    out = []
    for i, held, w in seqs:
        h = ["<s>", *w]
        each = [p(tuple(h[max(0, j - depth) : j]), h[j]) for j in range(1, len(h))]
        base = [p((), x) for x in w]
        out.append((i, held, len(w), sum(count[()][x] > 0 for x in w), N, sum(map(math.log10, base)), sum(map(math.log10, each))))
    return out, len(states), p, count, V


@pytest.mark.parametrize("depth,least,gain", [(2, 3, 1.0), (1, 2, 0.5), (3, 2, 0.2)])
def test_suffix_tree(spark, depth, least, gain):
    rows = docs(depth)
    want, states, p, count, V = brute_scores(rows, depth, least, gain)
    assert states > 5
    got = suffix_tree_lm.score(frame(spark, rows), depth, least, gain).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 6), round(x[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    # a state's distribution over the known tokens and one unknown one sums to 1
    for ctx in (("w1",), ("w1", "w2"), ()):
        assert sum(p(ctx, w) for w in list(count[()])) + p(ctx, "never") == pytest.approx(1)


def test_suffix_tree_odd_tables(spark, monkeypatch):
    assert suffix_tree_lm.score(frame(spark, [])).count() == 0
    only = next(i for i in range(100) if suffix_tree_lm.held_out(i))
    assert [tuple(r) for r in suffix_tree_lm.score(frame(spark, [(only, "a b")])).collect()] == [(only, True, 3, 0, 0, 0.0, 0.0)]
    rows = docs(5)
    usual = sorted(str(tuple(r)) for r in suffix_tree_lm.score(frame(spark, rows)).collect())
    monkeypatch.setattr(suffix_tree_lm.X, "parts", lambda spark, size, each: 3)
    monkeypatch.setattr(suffix_tree_lm, "SHARD", 2000)
    assert sorted(str(tuple(r)) for r in suffix_tree_lm.score(frame(spark, rows).repartition(2)).collect()) == usual


def test_suffix_tree_passes_tell_only_what_is_new():
    S, given = suffix_tree_lm, [f"a b a b c a b d{i}".encode() for i in range(6)]
    held = pa.table({"part": pa.array([7], pa.int64()), "payload": pa.array([S._packed(given, list(range(6)))], pa.binary())})
    learned = [i for i in range(6) if not S.held_out(i)]
    heard = []
    for number, kinds in enumerate(({1, 2}, {S.STATES + 1, 3}, {S.STATES + 2}), 1):
        told = S._pass(number, 2, 1, 3, 9 * len(learned), 64)(held, *([pa.concat_tables(heard)] if heard else []))
        assert set(told.column("kind").to_pylist()) == kinds
        messages = told.to_pylist()
        for k, part in {(m["kind"], m["part"]) for m in messages}:
            heard.append(S._bucket(1.0)(S._told([(k, part, m["payload"]) for m in messages if (m["kind"], m["part"]) == (k, part)])))
    assert S._Answers(pa.concat_tables(heard)).vocabulary() == 4 + len(learned)
    out = S._pass(4, 2, 1, 3, 9 * len(learned), 64)(held, pa.concat_tables(heard))
    assert out.column("n_tokens").to_pylist() == [9] * 6


def test_suffix_tree_sorts_no_places_beside_keys(monkeypatch):
    """Positions are sorted as plain numbers; only the different words' keys go through np.unique."""
    S, rng = suffix_tree_lm, np.random.default_rng(5)
    given = [" ".join(f"w{i}" for i in rng.integers(0, 30, 200)).encode() for _ in range(20)]
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (sizes.append(len(x)), unique(x, *a, **k))[1])
    held = pa.table({"part": pa.array([7], pa.int64()), "payload": pa.array([S._packed(given, list(range(20)))], pa.binary())})
    heard = []
    for number in range(1, 4):
        for m in S._pass(number, 2, 3, 3, 3000, 64)(held, *([pa.concat_tables(heard)] if heard else [])).to_pylist():
            heard.append(S._bucket(1.0)(S._told([(m["kind"], m["part"], m["payload"])])))
    assert S._pass(4, 2, 3, 3, 3000, 64)(held, pa.concat_tables(heard)).column("n_tokens").to_pylist() == [201] * 20
    assert sizes and max(sizes) <= 32  # 30 words, the end and the start; positions are 4,020


def test_places_in_order_of_keys():
    rng, some = np.random.default_rng(4), np.arange(300, dtype=np.uint64)
    alike = np.uint64(0xABCDEF << 40) + rng.integers(0, 200, 5000, dtype=np.uint64)  # differ in the bits that places take
    for keys, bits in ((rng.integers(0, 1 << 40, 5000, dtype=np.uint64), 40), (rng.integers(0, 50, 5000, dtype=np.uint64), 56), (alike, 64), (np.append(alike[:9], rng.integers(0, 1 << 64, 5000, dtype=np.uint64)), 64), (some[:1], 64), (some[:0], 64), (some[::-1], 64)):
        order, starts, different = suffix_tree_lm._in_order(keys, bits)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist()
        assert keys[order[starts]].tolist() == different.tolist() == sorted(set(keys.tolist()))
        at = np.arange(len(keys)) + 7
        values = np.arange(len(keys) + 7)
        groups = (suffix_tree_lm._Sorted(at, keys, bits), suffix_tree_lm._Numbered(at, np.append(unique := np.unique(keys), keys[:1] + np.uint64(1)), np.searchsorted(unique, keys).astype(np.uint32)))
        want = defaultdict(int)
        for p, k in zip(at.tolist(), keys.tolist(), strict=True):
            want[k] += p
        for g in groups:
            assert dict(zip(g.keys.tolist(), g.total(values).tolist(), strict=True)) == want and g.keys.tolist() == sorted(want)
            assert dict(zip(g.positions.tolist(), g.each(g.keys).tolist(), strict=True)) == dict(zip(at.tolist(), keys.tolist(), strict=True))


def test_suffix_tree_shuffles_replies_once(spark):
    got = suffix_tree_lm.score(frame(spark, docs(3)))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # packed documents, then what is told and answered in three passes; the union of answers keeps their partitioning
    assert "Union" in plan and len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) - len(re.findall(r"ReusedExchange.*Exchange hashpartitioning", plan)) <= 7


def test_block_hashes():
    turned = lambda s: s.translate(str.maketrans("ab", "ba"))
    a = "a"
    while len(a) < 1024:
        a += turned(a)
    texts = [a, turned(a), "", "x", "x\x00", "12345678", "123456789", "1234567890123456", "é" * 5, a]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = np.array([0, *ends[:-1]])
    keep = ends > starts
    h = textkit.block_hashes(buf, starts[keep], ends[keep])
    assert len(set(h.tolist())) == len(h) - 1 and h[0] == h[-1]
    assert (textkit.block_hashes(buf, starts[keep], ends[keep], step=3) == h).all()
    assert not set(textkit.block_hashes(buf, starts[keep], ends[keep], salt=1).tolist()) & set(h.tolist())


def test_sorted_keys_travel_whole():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 1000):
        for high in (n + 5, 1 << 40, 1 << 64):
            keys = np.unique(rng.integers(0, high, n, dtype=np.uint64, endpoint=high < 1 << 64) if high < 1 << 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True))
            assert (exchange.get_keys(exchange.put_keys(keys)) == keys).all()
    edge = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert (exchange.get_keys(exchange.put_keys(edge)) == edge).all()
