"""Distributed byte-pair training against recounting everything, with small tables, folds and ranges of any size."""

import random
import time

import numpy as np
import pytest

from lakeloom.operators import bpe as P
from lakeloom.operators import bpe_train, stream_bpe
from lakeloom.operators.merging import LONG, merge_word

from .test_text import fuzz


def texts(seed):
    r = random.Random(seed)
    word = ["".join(r.choice("aab cé") for _ in range(r.randint(1, 9))) for _ in range(40)]
    return [" ".join(r.choice(word) for _ in range(r.randint(0, 60))) for _ in range(12)] + ["a" * 301, "", None, "aaaa bbbb " * 20] + fuzz(5, seed)


def counts(spark, given):
    return P.chunk_counts(spark.createDataFrame(list(enumerate(given)), "o long, text string"), "o").where("chunk IS NOT NULL")


@pytest.mark.parametrize("seed,fold,few", [(1, 512, 1 << 18), (2, 9, 3)])
def test_training_agrees(spark, monkeypatch, seed, fold, few):
    monkeypatch.setattr(bpe_train, "FOLD", fold)
    monkeypatch.setattr(bpe_train, "FEW", few)
    made = counts(spark, texts(seed))
    rows = made.orderBy("first_text", "first_pos").collect()
    want = P.learn([([ord(c) for c in r["chunk"]], r["n"]) for r in rows], 45)
    learner = bpe_train.Learner(made)
    assert learner.run(45) == want
    assert learner.rounds < 40


def test_training_ends(spark):
    assert bpe_train.learn(counts(spark, ["abc"]), 50) == [(97, 98), (256, 99)]
    assert bpe_train.learn(counts(spark, []), 5) == []


def test_training_by_rounds(spark):
    """Rounds hold several merges, and one of a pair with itself does not hide what comes of it."""
    head = [(1 << 32 | 1, 100), (2 << 32 | 3, 60), (4 << 32 | 5, 50)]
    assert bpe_train.independent(head, 9, head) == [1 << 32 | 1, 2 << 32 | 3]
    head = [(1 << 32 | 2, 9), (3 << 32 | 4, 8), (2 << 32 | 7, 8)]
    assert bpe_train.independent(head, 9, head) == [1 << 32 | 2]
    head = [(1 << 32 | 2, 9), (1 << 32 | 4, 8), (5 << 32 | 6, 7), (6 << 32 | 1, 6)]
    assert bpe_train.independent(head, 9, head) == [1 << 32 | 2, 1 << 32 | 4, 5 << 32 | 6]


def slow_stream(data, n):
    ids, merges = list(data), []
    while len(merges) < n and len(ids) > 1:
        total = {}
        for p in zip(ids, ids[1:]):
            total[p] = total.get(p, 0) + 1
        best = max(total, key=total.get)
        merges.append(best)
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best:
                out.append(255 + len(merges))
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return merges


@pytest.mark.parametrize("size,dense", [(1, 1 << 22), (3, 0), (50, 0), (100_000, 1 << 22)])
def test_stream_training(spark, monkeypatch, size, dense):
    monkeypatch.setattr(stream_bpe, "DENSE", dense)
    given = ["aaaaaaa", None, "aab" * 11, "", "é" * 9 + "abab", "aaaaa" * 9, "the cat, the hat"]
    data = "".join(t or "" for t in given).encode()
    df = spark.createDataFrame([(7 * i, t) for i, t in enumerate(given)], "k long, text string").repartition(3)
    assert stream_bpe.train(df, "k", 14, size=size) == slow_stream(data, 14)


def test_stream_rounds_by_hand():
    """Random streams in ranges of random sizes: each round as on one array."""
    r = random.Random(4)
    for _ in range(300):
        ids = [r.choice([1, 1, 2, 3]) for _ in range(r.randint(2, 40))]
        new = r.choice([{1 << 32 | 1: 300}, {1 << 32 | 2: 300, 1 << 32 | 3: 301}, {2 << 32 | 2: 300, 1 << 32 | 3: 301}])
        want = stream_bpe.merged(np.array(ids, np.int32), new).tolist()
        cuts = sorted(r.randint(0, len(ids)) for _ in range(r.randint(0, 12)))
        parts = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]
        edges = []
        for k, p in enumerate(parts):
            if p:
                tail = next((i for i, x in enumerate(reversed(p)) if x != p[-1]), len(p))
                edges.append((k, len(p), p[0], p[-1], tail))
        borders = stream_bpe.stitched(edges, new)
        got = []
        for k, p in enumerate(parts):
            dropped, last = borders.get(k, (False, -1))
            x = stream_bpe.merged(np.array(p[1:] if dropped else p, np.int32), new).tolist()
            got += x[:-1] + [last] if last >= 0 else x
        assert got == want, (ids, parts, new)


def test_stream_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "k long, text string")
    assert stream_bpe.train(none, "k", 3) == [] and stream_bpe.train(none.limit(0), "k", 3) == []
    assert stream_bpe.train(spark.createDataFrame([(1, "a")], "k long, text string"), "k", 3) == []


def test_long_chunks():
    r = random.Random(9)
    for n in (LONG, LONG + 1, 400):
        word = [r.choice([97, 97, 98, 99]) for _ in range(n)]
        merges = P.learn([(list(word), 1)], 60)
        ranks = {p: k for k, p in enumerate(merges)}
        want = word
        for k, p in enumerate(merges):
            out, i = [], 0
            while i < len(want):
                if want[i : i + 2] == list(p):
                    out.append(256 + k)
                    i += 2
                else:
                    out.append(want[i])
                    i += 1
            want = out
        assert merge_word(list(word), ranks) == want
    ranks = {p: k for k, p in enumerate(P.learn([(list(b"abcabdabe" * 50), 1)], 100))}
    began = time.time()
    got = merge_word([r.choice(b"abcde") for _ in range(1 << 20)], ranks)
    assert len(got) < 1 << 20 and time.time() - began < 60


def test_stream_ranges_are_stored_every_other_round(spark, monkeypatch):
    """Ranges are not written in each round, and merges across borders are the same."""
    from lakeloom.operators import stream_bpe as S

    kept, own = [], S.keep
    monkeypatch.setattr(S, "keep", lambda *a, **k: kept.append(own(*a, **k)) or kept[-1])
    monkeypatch.setattr(S, "drop", lambda t: None)
    r = random.Random(11)
    texts = ["".join(r.choice("aab c") for _ in range(r.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = S.train(df, "k", 14, size=10**6)
    held = [t.where("ids IS NOT NULL").count() > 0 for t in kept]
    assert held == [i % S.FOLD == 0 for i in range(len(held))] and len(held) > S.FOLD + 1
    assert S.train(df, "k", 14, size=3) == want
    assert want == slow_stream("".join(texts).encode(), 14)


def test_stream_is_stored_compressed(spark, monkeypatch):
    """Ranges that Spark reads, batches and writes are compressed by the workers: under a byte a token, whatever codec the files have, and not dealt by kind."""
    from lakeloom.operators import stream_bpe as S

    kept, own = [], S.keep
    monkeypatch.setattr(S, "keep", lambda df, name, *by, **k: kept.append((own(df, name, *by, **k), by)) or kept[-1][0])
    monkeypatch.setattr(S, "drop", lambda t: None)
    df = spark.createDataFrame([(i, "the cat and the hat " * 50) for i in range(200)], "k long, text string")
    S.train(df, "k", 6)
    held = [t.where("kind = 0 AND ids IS NOT NULL").selectExpr("sum(octet_length(ids))", "sum(n)").first() for t, _ in kept]
    assert held[0][1] == 200_000 and all(2 * r[0] < r[1] for r in held if r[1])
    assert not any(by for _, by in kept)


@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_stream_in_parts(spark, monkeypatch, dense):
    """Many parts, texts longer than a piece, keys in any order, ranges that go over several texts: as one stream, ties too."""
    for name, value in (("PART", 40), ("RANGE", 7), ("DENSE", dense), ("HANDED", 600)):
        monkeypatch.setattr(stream_bpe, name, value)
    r = random.Random(7)
    given = {r.randint(-(10**12), 10**12): r.choice(["", None, "ab" * r.randint(1, 30), "".join(r.choice("aab é") for _ in range(r.randint(0, 40)))]) for _ in range(60)}
    rows = list(given.items())
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, text string").repartition(5)
    assert stream_bpe.train(df, "k", 20) == slow_stream("".join(given[k] or "" for k in sorted(given)).encode(), 20)


def test_stream_rounds_in_a_table():
    """Merges and counts by an array of all pairs are those without it."""
    r = random.Random(5)
    for _ in range(200):
        given = [np.array([r.choice([1, 1, 2, 3]) for _ in range(r.randint(2, 200))], np.uint16) for _ in range(3)]
        new = r.choice([{1 << 32 | 1: 6}, {1 << 32 | 2: 6, 1 << 32 | 3: 7}, {2 << 32 | 2: 6, 1 << 32 | 3: 7}])
        table = stream_bpe.made_of(new, 8, "<u2")
        assert all(stream_bpe.merged(x, new, table, 8).tolist() == stream_bpe.merged(x, new).tolist() for x in given)
        a, b = stream_bpe.Counts(8), stream_bpe.Counts(0)
        for no, x in zip((9, 4, 6), given, strict=True):
            a.add(no, x)
            b.add(no, x)
        assert sorted(zip(*(c.tolist() for c in a.rows()), strict=True)) == sorted(zip(*(c.tolist() for c in b.rows()), strict=True))
        x = given[0]
        assert stream_bpe._tail(x) == next((i for i, v in enumerate(reversed(x.tolist())) if v != x[-1]), len(x))
