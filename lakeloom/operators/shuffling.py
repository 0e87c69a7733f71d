"""A seeded order of any number of rows without a list of it: each position computes its place.

Positions 0 to n - 1 stand on a grid of a x b cells, as nearly square as can be. A round adds a keyed function of one coordinate to the other, which is a
bijection of the grid; cells from n on (fewer than a) are left by going on until a cell under n comes.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, STEPS = 6, 40
# primes under 2**31: products of what is below them stay under 2**62
_P, _Q = 2147483647, 2147483629


def keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers for each round."""
    out = []
    for k in range(ROUNDS):
        d = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        out.append(tuple(int.from_bytes(d[4 * i : 4 * i + 4], "big") % (1 << 30) + 1 for i in range(3)))
    return out


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a)


def steps(n: int) -> int:
    """Rounds of rounds that may be needed to get to a cell under n. There are a * b - n other cells; where they are more than STEPS, to meet more than STEPS of them in a row has a
    chance under 40**-40, and it would be an error."""
    a, b = grid(n)
    return min(a * b - n, STEPS)


def shuffled_place(position: Column, n: int, seed: int) -> Column:
    """The place of each position under n in the seeded order."""
    if n <= 1:
        return position.cast("long")
    a, b = grid(n)

    def cell(x: Column) -> Column:
        low, high = x % a, F.call_function("div", x, F.lit(a))
        for k, (c, d, e) in enumerate(keys(seed)):
            if k % 2:
                high = (high + (low * c + d) % _P * e % _Q) % b
            else:
                low = (low + (high * c + d) % _P * e % _Q) % a
        return low + high * a

    first = cell(position.cast("long"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps(n))), first, lambda v, _: F.when(v >= n, cell(v)).otherwise(v)) if steps(n) else first
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("no place found")).cast("long"))
