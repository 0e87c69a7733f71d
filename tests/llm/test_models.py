"""The fitted operators: held-out accuracy and defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import embedding_dedup, features, mixing, quality, setsketch, toxicity

EXTRA = "doc_id long, text string, kept string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], EXTRA).repartition(3)


def text(r, n, alphabet="abcdefgh"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


def test_ordinal_grades(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        g = r.randrange(3)
        t = text(r, 60)
        rows.append((i, " ".join(w + "!" * 2 if r.random() < 0.45 * (2 - g) else w for w in t.split())))
        labels.append((i, float(g * 2)))
    rows += [(9000, None), (9001, ""), (None, "abc")]
    labelled = spark.createDataFrame(labels[:400] + [(None, 1.0), (9000, None)], "id long, y double")
    got = {x["doc_id"]: x for x in quality.graded(frame(spark, rows), labelled, grade=2.0).collect()}
    truth = dict(labels)
    held = range(400, 600)
    assert len(got) == len(rows)
    assert np.corrcoef([truth[i] for i in held], [got[i]["expected_grade"] for i in held])[0, 1] > 0.85
    assert np.mean([(truth[i] >= 2) == got[i]["kept"] for i in held]) > 0.85
    model = quality.fit(frame(spark, rows), labelled)
    assert list(model.grades) == [0, 2, 4] and model.thresholds[0] < model.thresholds[1]
    kept = quality.keep(frame(spark, rows), labelled, 2.0)
    assert kept.columns == ["doc_id", "text", "kept", "score"] and 0 < kept.count() < len(rows)
    none = quality.graded(frame(spark, rows), labelled.limit(0))
    assert none.where("kept").count() == len(rows)


def test_toxicity_from_positive_and_unlabelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        t = text(r, r.randint(20, 200)).split()
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["grobian", "grobiander", "nitwit"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, "")]
    got = {x["doc_id"]: x for x in toxicity.scored(frame(spark, rows), spark.createDataFrame(labels, "id long, y int")).collect()}
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert 0 <= got[5000]["score"] == got[5001]["score"] < 0.5
    clean = toxicity.scored(frame(spark, rows), spark.createDataFrame([(1, 0)], "id long, y int"))
    assert clean.where("predicted = 1").count() == 0


def test_mixing_meets_targets(spark):
    r = random.Random(2)
    kinds = {"x": "abcd", "y": "mnop", "z": "uvwx"}
    rows = [(i, text(r, r.randint(5, 80), kinds[k])) for i, k in enumerate(r.choices("xyz", [6, 3, 1], k=400))]
    labelled = spark.createDataFrame([(i, k) for i, (_, t) in enumerate(rows) for k in [next(k for k, a in kinds.items() if t[0] in a)] if i % 3 == 0], "id long, y string")
    docs = frame(spark, [*rows, (900, None)])
    targets = {"x": 0.3, "y": 0.3, "z": 0.4}
    got = mixing.mix(docs, labelled, targets).withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).collect()
    p, n, rate = np.array([x["posteriors"] for x in got]), np.array([x["n_tokens"] for x in got]), np.array([x["rate"] for x in got])
    assert np.allclose((rate * n) @ p / n.sum(), [0.3, 0.3, 0.4], atol=0.01) and (rate >= 0).all()
    assert np.allclose(p.sum(1), 1)
    assert abs(np.mean([x["copies"] for x in got]) - rate.mean()) < 0.1
    again = mixing.mix(docs.withColumn("rate", F.lit(-1.0)).withColumn("row", F.lit(7)), labelled, targets)
    assert again.columns.count("rate") == 1 and sorted(x["rate"] for x in again.collect()) == sorted(rate) and again.where("row = 7").count() == len(rate)
    assert {x["rate"] for x in mixing.mix(docs, labelled.limit(0), targets).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, targets).count() == 0


def test_mixing_query_on_any_labels(spark, tmp_path):
    r = random.Random(6)
    kinds = {"en": "abcd", "fr": "mnop", "de": "uvwx", "es": "efgh", "it": "ijkl"}
    rows = [(i, text(r, 30, kinds[k]), k) for i, k in enumerate(r.choices(list(kinds), k=300))]
    rows += [(5, "abc dcb " * 30, "en"), (5, rows[5][1], rows[5][2]), (None, None, None), (901, "", "fr")]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def run(name, docs, ids):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        return {(x["doc_id"], x["n_tokens"], k): x for k, x in enumerate(sorted(mixing.op9_mixing(spark, f"{tmp_path}/{name}").collect(), key=str))}.values()

    none = run("none", docs, [])
    assert len(none) == len(rows) and all(x["rate"] == 1 and x["copies"] == 1 and x["p_en"] is None for x in none)
    one = run("one", docs, [x[0] for x in rows if x[2] == "fr"])
    assert all(x["p_fr"] == 1 and x["p_de"] is None for x in one)
    three = run("three", docs, [x[0] for x in rows if x[2] in ("fr", "en", "de")])
    assert all(x["p_es"] is None and abs(x["p_fr"] + x["p_en"] + x["p_de"] - 1) < 1e-9 for x in three)
    five = run("five", docs, [x[0] for x in rows])
    lang = {x[0]: x[2] for x in rows if x[0] != 5}
    sure = [x for x in five if x["doc_id"] in lang and x["n_tokens"]]
    assert np.mean([x[f"p_{lang[x['doc_id']]}"] > 0.5 for x in sure if lang[x["doc_id"]] != "it"]) > 0.95
    assert all(x["p_en"] + x["p_fr"] + x["p_de"] + x["p_es"] < 0.5 for x in sure if lang[x["doc_id"]] == "it")
    assert list(map(str, five)) == list(map(str, run("again", docs.repartition(5), [x[0] for x in rows])))
    assert not run("empty", docs.limit(0), [1, 2])


@pytest.mark.parametrize("shares", [(0.62, 0.145, 0.129, 0.106), (0.95, 0.03, 0.015, 0.005), (0.97, 0.02, 0.009, 0.001)])
def test_rates_of_rare_domains(shares):
    wanted, penalty, n = np.array([0.4, 0.2, 0.2, 0.2]), 1e-3, 1000 * np.array(shares)
    gap = mixing.solve(lambda points: mixing.dual_sums(np.eye(4), n, points, penalty), wanted, n.sum(), penalty, 40, 1e-4)
    assert np.allclose(mixing.rates_at(np.eye(4), gap, penalty), (wanted + penalty) / (np.array(shares) / sum(shares) + penalty), atol=1e-3)
    r = np.random.default_rng(4)
    p = r.dirichlet(np.array(shares) * 2, 3000)
    n = r.integers(0, 500, 3000).astype(float)
    gap = mixing.solve(lambda points: mixing.dual_sums(p, n, points, penalty), wanted, n.sum(), penalty, 40, 1e-4)
    assert np.allclose((mixing.rates_at(p, gap, penalty) * n) @ p / n.sum() - wanted, gap, atol=1e-6)
    with pytest.raises(RuntimeError):
        mixing.solve(lambda points: mixing.dual_sums(p, n, points, penalty), wanted, n.sum(), penalty, 1, 1e-4)


@pytest.mark.parametrize("counts", [(950, 30, 15, 5), (2910, 60, 27, 3)])
def test_mixing_with_a_rare_domain(spark, recwarn, counts):
    r = random.Random(5)
    kinds = {"w": "abcd", "x": "mnop", "y": "uvwx", "z": "efgh"}
    own = [k for k, n in zip(kinds, counts) for _ in range(n)]
    rows = [(i, text(r, 40, kinds[k])) for i, k in enumerate(own)]
    labelled = spark.createDataFrame(list(enumerate(own)), "id long, y string")
    got = mixing.mix(frame(spark, rows), labelled, {"w": 0.4, "x": 0.2, "y": 0.2, "z": 0.2}).collect()
    p, n, rate = np.array([x["posteriors"] for x in got]), np.array([x["n_tokens"] for x in got]), np.array([x["rate"] for x in got])
    assert np.allclose((rate * n) @ p / n.sum(), [0.4, 0.2, 0.2, 0.2], atol=1e-3) and (rate >= 0).all()
    assert not [w for w in recwarn if "miss their targets" in str(w.message)]


@pytest.mark.parametrize("shares", [(0.62, 0.145, 0.129, 0.106), (0.97, 0.02, 0.009, 0.001)])
def test_descent_against_all_rates_by_hand(shares):
    """Moves that rates are made from again and again, against rates that are kept and moved in place; perfect and soft posteriors."""
    r = np.random.default_rng(4)
    wanted = np.array([0.4, 0.2, 0.2, 0.2])
    for p in (np.eye(4)[r.choice(4, 4000, p=np.array(shares) / sum(shares))], r.dirichlet(np.array(shares) * 0.2, 4000)):
        n = r.integers(1, 500, 4000).astype(float)
        share = n @ p / n.sum()
        moves, gap = mixing.descend(lambda m: (mixing.rates_after(p, m) * n) @ p / n.sum(), share, wanted, None, 60, 5e-4)
        rate, seen = np.ones(len(n)), share > 0
        for _ in moves:
            rate = np.maximum(0, rate - p @ (((rate * n) @ p / n.sum() - wanted) / np.maximum(share, 1e-300)))
        assert np.allclose(rate, mixing.rates_after(p, moves)) and np.abs(gap[seen]).max() <= 1e-3


def test_targets_that_cannot_be_met():
    p, n = np.full((100, 2), 0.5), np.ones(100)
    moves, gap = mixing.descend(lambda m: (mixing.rates_after(p, m) * n) @ p / n.sum(), n @ p / n.sum(), np.array([0.9, 0.1]), None, 60, 5e-4)
    assert len(moves) < 5 and np.allclose(gap, [-0.4, 0.4], atol=1e-2)


def brute_links(rows, similarity):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            a /= np.abs(a).max()
            ok[k] = a / np.linalg.norm(a)
    parent = {rows[k][0]: rows[k][0] for k in ok}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = {k: 0 for k in ok}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= similarity:
                n[a] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return sorted([(i, n.get(k, 0), find(i) if k in ok else i, i is not None and (k not in ok or find(i) == i)) for k, (i, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("d", [64, 7, 2])
def test_embedding_links(spark, monkeypatch, d):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    r = np.random.default_rng(d)
    centres = r.normal(size=(12, d))
    rows = [(int(i), [float(x) for x in np.float32(centres[r.integers(12)] + r.normal(size=d) * r.choice([0.02, 0.25, 2.0]))]) for i in range(250)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, None), (703, []), (704, [0.0] * d), (705, [None] * d), (706, [float("nan")] * d), (707, [float("inf")] * d), (708, rows[3][1] + [0.0]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string").repartition(4)
    got = embedding_dedup.embedding_links(df).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows, 0.9)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_filters_shared_by_near_vectors():
    r = np.random.default_rng(0)
    code = embedding_dedup.Codes(64, 20000, 0.9)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * o / np.linalg.norm(o, axis=1, keepdims=True)
    (ra, fa), (rb, fb) = code.decode(a), code.decode(b)
    shared = [len(set(fa[ra == i]) & set(fb[rb == i])) for i in range(400)]
    assert min(shared) > 0 and 15 < np.mean(shared) < 60
    full = (a @ code.rotations[0])[:, :32] @ code.codes[0][0]
    direct = {(i, x * code.words + y) for i, x, y in zip(*np.nonzero(full[:, :, None] + ((a @ code.rotations[0])[:, 32:] @ code.codes[0][1])[:, None, :] >= code.least))}
    assert direct == {(i, f) for i, f in zip(ra, fa) if f < code.words**2}


def test_sketches():
    r = np.random.default_rng(1)
    common = r.integers(0, 2**63, 850).astype(np.uint64)
    pairs = []
    for k in range(40):
        x, y = r.integers(0, 2**63, (2, 75)).astype(np.uint64)
        h = np.concatenate([common, x, common, y])
        pairs.append(setsketch.registers(h, np.array([0, 925, 1850]), 256))
        both = setsketch.registers(np.concatenate([common, x, y]), np.array([0, 1000]), 256)
        assert (setsketch.merge(pairs[-1][0], pairs[-1][1]) == both[0]).all()
    a, b = np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])
    est = setsketch.joint_jaccard(a, b, np.full(40, 925), np.full(40, 925))
    assert abs(est.mean() - 0.85) < 0.02


def test_features_of_empty_texts():
    for make in (features.grams, features.words):
        row, _, _ = make([b"", b"abc abc", b""])
        assert set(row) == {1}
        assert len(make([b"", b""])[0]) == 0
