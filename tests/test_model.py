import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.errors import EmbeddingsError
from lakeloom.functions import vectors as V
from lakeloom.operators import model as M
from lakeloom.operators import training as R


def vec(spark, values, expr):
    return spark.createDataFrame([([float(v) for v in values],)], "x array<double>").select(expr.alias("y")).first()["y"]


def test_filters(spark):
    x = F.col("x")
    assert [v for v in vec(spark, [5, 1, 3, 2, 4], V.top_k(x, 3)) if v > -math.inf] == [5, 3, 4]
    assert [v for v in vec(spark, [8, 5, 3, 2, 1], V.top_p(x, 0.95)) if v > -math.inf] == [8, 5]
    assert vec(spark, [1, 3, 3], V.greedy(x)) == 1
    assert vec(spark, [0, 0, 0, 0], V.multinomial(x, F.lit(0.6))) == 2
    assert vec(spark, [1, 9], V.pick(x, "sample", 0.5, 1, 0.9, F.lit(0.99))) == 1
    with pytest.raises(ValueError):
        V.pick(x, "beam")


def test_gelu_and_norm(spark):
    x = [-1.0, 0.0, 2.0]
    assert np.allclose(vec(spark, x, V.gelu(F.col("x"))), [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x])
    a = np.array(x)
    assert np.allclose(vec(spark, x, V.layer_norm(F.col("x"))), (a - a.mean()) / np.sqrt(a.var() + 1e-5))


def weights(rng, layers=1, d=4, v=7, ctx=5):
    w = {"wte.weight": rng.normal(size=(v, d)), "wpe.weight": rng.normal(size=(ctx, d)), "ln_f.weight": np.ones(d), "ln_f.bias": np.zeros(d)}
    for i in range(layers):
        for n in ("1", "2"):
            w[f"h.{i}.ln_{n}.weight"], w[f"h.{i}.ln_{n}.bias"] = rng.normal(size=d), rng.normal(size=d)
        for n, shape in (("attn.c_attn", (d, 3 * d)), ("attn.c_proj", (d, d)), ("mlp.c_fc", (d, 2 * d)), ("mlp.c_proj", (2 * d, d))):
            w[f"h.{i}.{n}.weight"], w[f"h.{i}.{n}.bias"] = rng.normal(size=shape), rng.normal(size=shape[1])
    return w


def test_remap_and_forward(spark):
    raw = weights(np.random.default_rng(0))
    table = spark.createDataFrame([(k, list(a.shape), a.reshape(-1).tolist()) for k, a in raw.items()], "name string, shape array<int>, data array<double>")
    got = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in M.remap_weights(table).collect()}
    q, k, v = np.split(raw["h.0.attn.c_attn.weight"], 3, axis=1)
    assert np.allclose(got["blocks.0.attn.k_proj.weight"], k.T) and np.allclose(got["blocks.0.attn.v_proj.weight"], v.T)
    assert np.allclose(got["blocks.0.attn.q_proj.bias"], raw["h.0.attn.c_attn.bias"][:4])
    assert np.allclose(got["blocks.0.mlp.fc1.weight"], raw["h.0.mlp.c_fc.weight"].T) and np.allclose(got["blocks.0.ln2.shift"], raw["h.0.ln_2.bias"])
    model = M.Gpt2(got, 2)
    a, b = model.logits([1, 2, 3]), model.logits([1, 2, 4])
    assert a.shape == (3, 7) and np.allclose(a[:2], b[:2])  # causal
    with pytest.raises(EmbeddingsError):
        model.logits([0] * 6)


def test_generate(spark):
    nxt = lambda ids: np.eye(10)[(ids[-1] + 1) % 10]
    assert list(M.generate_ids(nxt, [1], 4, 3)) == [2, 3, 4, 5] and list(M.generate_ids(nxt, [1], 9, 3, eos=4)) == [2, 3, 4]
    df = spark.createDataFrame([(0, [1, 2])], "k long, token_ids array<int>")
    assert M.generate(df, "k", lambda: nxt, 9, 4, eos=6).first()["generated"] == [3, 4, 5]


def test_counts_and_rates(spark):
    assert abs(M.gpt2_parameters("124M") - 124.439808) < 1e-6
    rows = R.learning_rates(spark, 1102, 6e-4, 100, 1000, 6e-5).orderBy("iter").collect()
    assert rows[0]["lr"] == pytest.approx(6e-4 / 101) and rows[1101]["lr"] == 6e-5 and rows[550]["lr"] == pytest.approx(6e-5 + 0.5 * (6e-4 - 6e-5))
    names = spark.createDataFrame([("a.bias",), ("ln1.scale",), ("w",)], "name string")
    assert {r["name"]: r["weight_decay"] for r in R.parameter_groups(names, 0.1).collect()} == {"a.bias": 0.0, "ln1.scale": 0.0, "w": 0.1}
    assert [r["iter"] for r in R.cadence(spark.range(7).withColumnRenamed("id", "iter"), "iter", 3).collect()] == [0, 3, 6]


def test_context_length():
    from types import SimpleNamespace as N

    from lakeloom.operators.model import context_length

    assert context_length(N(context_length=7), 1) == 7
    assert context_length(N(config={"context_length": 8}), 1) == context_length(N(config=N(context_length=8)), 1) == 8
    assert context_length(object(), 9) == context_length(N(config={}), 9) == 9
