"""Array arithmetic: sampling filters, normalisation, activations and attention pieces as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEGATIVE = float("-inf")


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def temperature(logits: Column, t: float) -> Column:
    return logits if t == 1 else F.transform(logits, lambda x: x / F.lit(float(t)))


def top_k(logits: Column, k: int) -> Column:
    """Values below the k-th largest become -inf; ties with it stay."""
    least = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return let(least, lambda t: F.transform(logits, lambda x: F.when(x < t, F.lit(NEGATIVE)).otherwise(x)))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    shifted = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def top_p(logits: Column, p: float) -> Column:
    """In falling order (ties by place), values whose predecessors' probabilities sum to more than p become -inf; the first stays."""
    order = let(softmax(logits), lambda w: F.array_sort(F.transform(w, lambda v, i: F.struct((-v).alias("down"), i.alias("i")))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def keep(o):
        n = F.aggregate(o, start, lambda a, v: F.struct((a["sum"] - v["down"]).alias("sum"), (a["n"] + F.when(a["sum"] > p, 0).otherwise(1)).alias("n")), lambda a: a["n"])
        return F.transform(F.slice(o, F.lit(1), n), lambda v: v["i"].cast("int"))

    return let(let(order, keep), lambda kept: F.transform(logits, lambda x, i: F.when(F.array_contains(kept, i.cast("int")), x).otherwise(F.lit(NEGATIVE))))


def greedy(logits: Column) -> Column:
    """Place of the first largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def multinomial(logits: Column, uniform: Column) -> Column:
    """The place that a uniform number in [0, 1) picks from the softmax."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    at = F.aggregate(softmax(logits), start, lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["at"] + F.when(a["sum"] + p <= uniform, 1).otherwise(0)).alias("at")), lambda a: a["at"])
    return F.least(at, F.size(logits) - 1)


def pick(logits: Column, strategy: str, t: float = 1.0, k: int | None = None, p: float | None = None, uniform: Column | None = None) -> Column:
    """The next token: "greedy", or "sample" after temperature, top-k and top-p in this order."""
    if strategy == "greedy":
        return greedy(logits)
    if strategy != "sample":
        raise ValueError(f"unknown strategy: {strategy}")
    u = F.rand() if uniform is None else uniform
    last = lambda x: multinomial(x, u)
    nucleus = last if p is None else lambda x: let(top_p(x, p), last)
    best = nucleus if k is None else lambda x: let(top_k(x, k), nucleus)
    return let(temperature(logits, t), best)


def layer_norm(x: Column, eps: float = 1e-5, scale: Column | None = None, shift: Column | None = None) -> Column:
    """With the population variance."""
    centred = let(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    out = let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda d: F.transform(c, lambda v: v / d)))
    out = out if scale is None else F.zip_with(out, scale, lambda a, b: a * b)
    return out if shift is None else add(out, shift)


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda r: F.transform(x, lambda v: v / r))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (F.lit(1.0) + F.exp(-v)))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(silu(gate), up, lambda a, b: a * b)


def rope(x: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary embedding; the first half pairs with the second."""
    half = F.size(x) / 2
    angle = lambda i: position * F.pow(F.lit(base), -(F.pmod(i, half)) / half)
    return F.transform(x, lambda v, i: v * F.cos(angle(i)) + F.when(i < half, -F.element_at(x, (i + half + 1).cast("int"))).otherwise(F.element_at(x, (i - half + 1).cast("int"))) * F.sin(angle(i)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gelu(x: pd.Series) -> pd.Series:
    """Exact GELU (SQL has no erf)."""
    erf = np.vectorize(math.erf, otypes=[float])
    return x.map(lambda v: 0.5 * np.asarray(v) * (1 + erf(np.asarray(v) / math.sqrt(2))) if len(v) else np.asarray(v))
