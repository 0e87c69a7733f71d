"""Routing against brute force, with one expert that all tokens want, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import experts as E


def brute(rows, k, most):
    queue = []
    for t, logits, x in rows:
        if t is None or not logits or x is None:
            continue
        best = sorted((-v, e) for e, v in enumerate(logits) if v is not None)[:k]
        total = sum(math.exp(best[0][0] - m) for m, _ in best)
        queue += [(e, c, t, math.exp(best[0][0] - m) / total, x) for c, (m, e) in enumerate(best)]
    queue.sort(key=lambda q: (q[0], q[1], q[2], -q[3], q[4]))
    out, seen = [], {}
    for e, c, t, g, x in queue:
        place = seen[e] = seen.get(e, -1) + 1
        out.append((t, c, e, round(g, 9), place, place < most))
    return out


@pytest.mark.parametrize("k,most", [(1, 40), (2, 25), (9, 10), (2, 0)])
def test_routes(spark, k, most):
    r = np.random.default_rng(k)
    rows = [(i, [float(np.round(v, 1)) for v in r.normal(size=5) + [4, 0, 0, 0, 0]], [float(i)] * 3) for i in range(150)]
    rows += [(None, [1.0], [1.0]), (7, None, [1.0]), (8, [], [1.0]), (9, [1.0, 2.0], None), (900, [None, 3.0, 3.0], [2.0] * 3), (900, [None, 3.0, 3.0], [2.0] * 3)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "n long, logits array<double>, v array<double>, expert int, place string").repartition(5)
    routed = E.route(df, "n", "logits", "v", k, most)
    got = [(x["token"], x["choice"], x["expert"], round(x["gate"], 9), x["place"], x["sent"]) for x in routed.collect()]
    assert sorted(got) == sorted(brute(rows, k, most))
    loads = routed.where("sent").groupBy("expert").count().collect()
    assert all(x["count"] <= most for x in loads)
    weights = spark.createDataFrame([(e, [float(e + 1)] * 3) for e in range(5)], "expert int, weights array<double>")
    sums = {}
    for t, _, e, g, _, sent in brute(rows, k, most):
        sums[t] = sums.get(t, 0.0) + (g * (e + 1) if sent else 0.0)
    for x in E.combine(routed.where("token < 900"), weights, lambda v, w: F.zip_with(v, w, lambda a, b: a * b)).collect():
        assert np.allclose(x["y"], sums[x["token"]] * x["token"])
    assert E.route(df.limit(0), "n", "logits", "v", k, most).count() == 0


def test_capacity():
    assert E.capacity(10, 4, 2) == 5 and E.capacity(11, 4, 2) == 6 and E.capacity(10, 4, 2, 1.25) == 7 and E.capacity(0, 0, 2) == 0
