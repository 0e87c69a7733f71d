"""Blocked attention against whole matrices."""

import numpy as np
import pytest

from lakeloom.operators.attention import attention, merge, partial


def brute(rows, causal, heads):
    out = {}
    for n, (s, p, q, _, _) in enumerate(rows):
        if p is None or q is None:
            continue
        near = [r for r in rows if r[0] == s and r[1] is not None and r[2] is not None and (not causal or r[1] <= p)]
        y = []
        width = len(q) // heads
        for h in range(heads):
            c = slice(h * width, (h + 1) * width)
            score = np.array([np.dot(q[c], r[3][c]) for r in near]) / np.sqrt(width)
            w = np.exp(score - score.max())
            y += list((w / w.sum()) @ np.array([r[4][c] for r in near]))
        out[n] = (s, p, y)
    return sorted(out.values(), key=lambda r: (str(r[0]), r[1], r[2]))


@pytest.mark.parametrize("causal,heads,block", [(True, 1, 4), (True, 2, 256), (False, 2, 3), (True, 4, 1)])
def test_attention(spark, causal, heads, block):
    r = np.random.default_rng(heads)
    vector = lambda scale=1.0: [float(x) for x in r.normal(size=8) * scale]
    rows = [("a", int(p), vector(30), vector(30), vector()) for p in [0, 1, 2, 3, 5, 9, 10, 11, 40, 41]] + [("b", 7, vector(), vector(), vector()), ("b", 7, vector(), vector(), vector())]
    rows += [("c", i, vector(), vector(), vector()) for i in range(23)]
    df = spark.createDataFrame([*rows, ("a", None, vector(), vector(), vector()), ("a", 4, None, vector(), vector())], "s string, p long, q array<double>, k array<double>, v array<double>").repartition(4)
    got = sorted(((x["s"], x["p"], x["y"]) for x in attention(df, "s", "p", causal=causal, heads=heads, block=block).collect()), key=lambda x: (x[0], x[1], x[2]))
    want = brute(rows, causal, heads)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert attention(df.limit(0), "s", "p").count() == 0


def test_states_merge_in_any_order():
    r = np.random.default_rng(1)
    q, k, v = (r.normal(size=(n, 2, 3)) * 40 for n in (5, 30, 30))
    whole = partial(q, k, v, None)
    parts = [partial(q, k[a : a + 6], v[a : a + 6], None) for a in range(0, 30, 6)]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 1, 3]):
        state = parts[order[0]]
        for i in order[1:]:
            state = merge(state, parts[i])
        assert all(np.allclose(a, b) for a, b in zip(state, whole))
    none = partial(q, k[:1], v[:1], np.zeros((5, 1), bool))
    assert all(np.allclose(a, b) for a, b in zip(merge(none, whole), whole))
