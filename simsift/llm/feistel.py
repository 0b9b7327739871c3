"""Keyed permutations of integer ranges, as columns.

A Feistel network over Z_a x Z_b: rounds in turn add a keyed hash of one half to
the other, modulo that half's size. Every round can be undone, so the whole is a
permutation of [0, a * b) for any sizes a and b, equal or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6


def _mixed(key: str, i: Column, half: Column, size: Column) -> Column:
    """Keyed hash of a half, in [0, size): 60 bits of md5."""
    hex15 = F.substring(F.md5(F.concat_ws(":", F.lit(key), i, half)), 1, 15)
    return F.conv(hex15, 16, 10).cast("bigint") % size


def feistel(x: Column, a: Column | int, b: Column | int, key: str, rounds: int = ROUNDS) -> Column:
    """Permutation of [0, a * b); x is a bigint in that range."""
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (a, b))

    def turn(halves: Column, i: Column) -> Column:
        left, right = halves["l"], halves["r"]
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (left + _mixed(key, i, right, a)) % a).otherwise(left).alias("l"),
            F.when(odd, right).otherwise((right + _mixed(key, i, left, b)) % b).alias("r"),
        )

    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))
    if rounds < 2:
        raise ValueError("a Feistel network needs two rounds at least")
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: s["l"] * b + s["r"])


def halves(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and less than a values to spare."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


#: Steps of a walk. A walk leaves [0, n) for at most ``a`` steps, and each step with a chance below
#: 1 / a: for a <= 64 none can take more, for larger ranges one in 64**64. It would raise, not err.
WALK = 64


def permute(x: Column, n: int, key: str, rounds: int = ROUNDS) -> Column:
    """Permutation of [0, n) by cycle walking: values beyond n are permuted again."""
    a, b = halves(n)
    size = F.lit(n).cast("bigint")

    def once(v: Column) -> Column:
        return feistel(v, a, b, key, rounds)

    def step(v: Column, _: Column) -> Column:
        return F.when(v < size, v).otherwise(once(v))

    def inside(v: Column) -> Column:
        return F.when(v < size, v).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), step, inside)
