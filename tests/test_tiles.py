"""Tiled products and the pre-norm block against NumPy."""

import numpy as np
import pytest

from lakeloom.operators import tiles
from lakeloom.operators.model import Gpt2

ROWS = "seq string, pos long, x array<double>, i int"


def weight_table(spark, w):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(w)], "i int, row array<double>").repartition(3)


@pytest.mark.parametrize("tile,block", [(2, 3), (256, 256), (3, 1)])
def test_matmul(spark, tile, block):
    r = np.random.default_rng(1)
    w = r.normal(size=(7, 5))
    rows = [(s, int(p), [float(v) for v in r.normal(size=7)], 0) for s in "ab" for p in [0, 1, 2, 5, 9]] + [("b", 9, [float(v) for v in r.normal(size=7)], 0)]
    df = spark.createDataFrame([*rows, ("a", None, [0.0] * 7, 1), ("a", 3, None, 1)], ROWS).repartition(3)
    got = sorted((x["seq"], x["pos"], x["y"]) for x in tiles.matmul(df, weight_table(spark, w), tile=tile, block=block).collect())
    want = sorted((s, p, list(np.array(x) @ w)) for s, p, x, _ in rows)
    assert [g[:2] for g in got] == [g[:2] for g in want] and np.allclose([g[2] for g in got], [g[2] for g in want])
    assert tiles.matmul(df.limit(0), weight_table(spark, w)).count() == 0


def test_block_is_that_of_the_model(spark):
    r = np.random.default_rng(2)
    d, n, vocabulary = 8, 6, 11
    shapes = {"attn.q_proj": (d, d), "attn.k_proj": (d, d), "attn.v_proj": (d, d), "attn.out_proj": (d, d), "mlp.fc1": (12, d), "mlp.fc2": (d, 12)}
    w = {"tok_emb.weight": r.normal(size=(vocabulary, d)), "pos_emb.weight": r.normal(size=(n, d)), "ln_f.scale": np.ones(d), "ln_f.shift": np.zeros(d)}
    for k, s in shapes.items():
        w[f"blocks.0.{k}.weight"], w[f"blocks.0.{k}.bias"] = r.normal(size=s) * 0.4, r.normal(size=s[0]) * 0.1
    for k in ("ln1", "ln2"):
        w[f"blocks.0.{k}.scale"], w[f"blocks.0.{k}.shift"] = r.normal(size=d), r.normal(size=d)
    ids = [3, 0, 10, 3, 7, 5]
    want = Gpt2(w, 2).logits(ids)
    x = w["tok_emb.weight"][ids] + w["pos_emb.weight"]
    rows = spark.createDataFrame([("s", i, [float(v) for v in row], 0) for i, row in enumerate(x)], ROWS)
    tables = {k.split(".")[1]: weight_table(spark, w[f"blocks.0.{k}.weight"].T) for k in shapes}
    vectors = {k.split(".")[1]: w[f"blocks.0.{k}.bias"].tolist() for k in shapes} | {f"{a}.{b}": w[f"blocks.0.{a}.{b}"].tolist() for a in ("ln1", "ln2") for b in ("scale", "shift")}
    out = tiles.transformer_block(rows, tables, 2, vectors, tile=3, block=4).orderBy("pos").collect()
    y = np.array([o["y"] for o in out])
    m = y - y.mean(1, keepdims=True)
    assert np.allclose(m / np.sqrt((m * m).mean(1, keepdims=True) + 1e-5) @ w["tok_emb.weight"].T, want)
