"""The pipeline's stages against brute force, long texts in all operators on texts, and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import decontaminate, features, mixing, near_dedup, quality, spill, substring_dedup, suffix_dedup, toxicity

from .test_exact import LOWER, brute_near, words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_stage(spark, docs):
    judged = {r["doc_id"]: r for r in quality.graded(docs, quality.ratings(spark, SF)).collect()}
    assert {i for i, r in judged.items() if r["tail"] >= 0.5} == {i for i, _ in pairs(STAGES["quality_classifier"](spark, docs, SF))}
    model = quality.fit(docs, quality.ratings(spark, SF))
    for i, t in pairs(docs)[:60]:  # the score of each text by itself, from the weights
        row, col, val = features.grams([(t or "").encode()])
        z = float(sum(v * model.weights[c] for c, v in zip(col, val)))
        assert abs(judged[i]["tail"] - 1 / (1 + np.exp(model.thresholds[0] - z))) < 1e-9


def test_near_dedup_stage(spark, docs):
    rows = pairs(docs)
    kept = {i for i, _, _, keep in brute_near(rows, 5, 80) if keep}
    assert {i for i, _ in pairs(STAGES["near_dedup"](spark, docs, SF))} == kept and len(kept) < len(rows)


def test_substring_stage(spark, docs):
    rows, n = pairs(docs), 50
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, i), i)
    want = {}
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = True
        if not (gone.all() and len(w)):
            want[i] = [x for x, g in zip(w, gone) if not g] if gone.any() else t
    got = dict(pairs(STAGES["substring_dedup"](spark, docs, SF)))
    assert got.keys() == want.keys()
    assert all(got[i] == v if isinstance(v, str) or v is None else words(got[i]) == v for i, v in want.items())


def test_decontaminate_stage(spark, docs):
    import re

    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [tok(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    clean = {i for i, t in pairs(docs) for w in [tok(t)] if not any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))}
    assert {i for i, _ in pairs(STAGES["decontaminate"](spark, docs, SF))} == clean and len(clean) < docs.count()


def test_mixing_stage(spark, docs):
    judged = {r["doc_id"]: r for r in mixing.mixed(spark, docs, SF).collect()}
    p, n = np.array([r["posteriors"] for r in judged.values()]), np.array([r["n_tokens"] for r in judged.values()], float)
    rate = np.array([r["rate"] for r in judged.values()])
    # the least squares of the shares, by many small steps on all rates from 1
    wanted, total, r = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)]), n.sum(), np.ones(len(n))
    left = lambda r: (r * n) @ p / total - wanted
    for _ in range(20000):
        r = np.maximum(0, r - 0.9 * (p @ left(r)))
    assert (rate >= 0).all() and np.abs(left(rate)).max() <= max(1e-3, 2 * np.abs(left(r)).max())
    rows = STAGES["mixing"](spark, docs, SF).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: r["copies"] for i, r in judged.items() if r["copies"]}


def test_texts_of_many_pieces(spark):
    """A text of 8 MB, a copy of it, and a benchmark passage near its end."""
    r = random.Random(0)
    known = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choices(known, k=1_250_000))
    passage = " ".join(f"item{i}" for i in range(12))
    docs = spark.createDataFrame([(1, long), (2, long + " . " + passage), (3, "short text of a few words"), (4, None)], "doc_id long, text string").repartition(3)
    n = long.count(" ") + 1
    cut = {x["doc_id"]: x for x in substring_dedup.remove_repeats(docs).collect()}
    assert [(cut[i]["n_words"], cut[i]["n_removed"]) for i in (1, 2, 3, 4)] == [(n, 0), (n + 13, n), (6, 0), (0, 0)]
    near = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    item = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert {x["doc_id"]: x["n_hit"] for x in decontaminate.contamination(docs, item).collect()} == {1: 0, 2: 12, 3: 0, 4: 0}
    gone = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.remove_repeated_bytes(docs).collect()}
    assert gone == {1: len(long), 2: len(long), 3: 0, 4: 0}
    labels = spark.createDataFrame([(1, 1.0), (3, 0.0), (4, 0.0)], "id long, y double")
    assert quality.graded(docs, labels).count() == 4
    assert toxicity.scored(docs, labels.select("id", F.col("y").cast("int").alias("y"))).where("score BETWEEN 0 AND 1").count() == 4
    mixed = {x["doc_id"]: x["n_tokens"] for x in mixing.mix(docs, labels.select("id", F.col("y").cast("string").alias("y")), {"0.0": 0.5, "1.0": 0.5}).collect()}
    assert mixed == {1: n, 2: n + 13, 3: 6, 4: 0}


def test_fitted_operators_on_empty_and_repeated_rows(spark):
    rows = [(i, f"word{i % 7} " * 30) for i in range(60)]
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(60)] + [(3, 0.0), (3, 1.0)], "id long, y double")
    docs = spark.createDataFrame([*rows, (3, "another text"), (3, "another text"), (None, "x"), (99, "")], "doc_id long, text string")
    toxic = labels.select("id", F.col("y").cast("int").alias("y"))
    for run in (lambda d, k: quality.graded(d, labels.limit(k)), lambda d, k: toxicity.scored(d, toxic.limit(k))):
        assert run(docs.limit(0), 100).count() == 0
        assert run(docs, 0).count() == docs.count()
        a, b = (sorted(map(str, run(docs.repartition(k), 100).collect())) for k in (2, 5))
        assert a == b  # the fit does not depend on the order of rows
        assert len({x for x in a if "doc_id=3," in x}) <= 2  # equal texts have equal scores
    x, y = features.sample(docs, labels, features.grams, 10)
    assert x.n == len(y) == 10


def test_shared_folder(spark, monkeypatch):
    t = spill.write(spark.range(3), "t")
    assert t.count() == 3
    spill.remove(t)
    with pytest.raises(Exception):
        t.count()
