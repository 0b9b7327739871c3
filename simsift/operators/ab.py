"""A/B time statistics on exact order statistics that scale with the data.

A rank is found by narrowing a range of values: each round counts the values of the range in at
most 1,024 sections, an aggregation that combines map-side, and goes on with the section that holds the rank. Doubles are compared
as whole numbers in the same order, so a round settles ten of at most 64 bits, whatever the distribution, and a
range ends early where its section holds one value. No group is ever sorted or held as a whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_BITS = 10
_MAGNITUDE = 2**63 - 1


def _as_order(x: Column) -> Column:
    """Whole number whose order is that of the doubles (-0.0 as 0.0, NaN last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(_MAGNITUDE)).otherwise(bits)


def _as_double(order: Column) -> Column:
    bits = F.when(order < 0, order.bitwiseXOR(_MAGNITUDE)).otherwise(order)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _rank_index(name: str, n: Column) -> Column:
    """0-based position in sorted order of a named rank."""
    last = n - F.lit(1)
    if name == "mid_low":
        return F.floor(last / F.lit(2))
    if name == "mid_high":
        return F.floor(n / F.lit(2))
    near = F.rint(F.lit(0.95) * last.cast("double")).cast("bigint")
    return F.least(last, near)


_RANKS = ("mid_low", "mid_high", "p95")


def _narrowed(values: DataFrame, wanted: DataFrame, by: list[str], few_groups: bool) -> DataFrame:
    """wanted (by, rank, n, at, low, high, below) with each range cut to the section that holds its rank."""
    renamed = wanted.select(*[F.col(c).alias(f"_{c}") for c in wanted.columns])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    near = same & F.col("_x").between(F.col("_low"), F.col("_high"))
    inside = values.join(F.broadcast(renamed) if few_groups else renamed, near).drop(*by)
    # the ten highest bits in which the range's ends differ
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("_low").bitwiseXOR(F.col("_high")))) - _BITS)
    section = F.expr("shiftright(_x, _shift)") - F.expr("shiftright(_low, _shift)")
    counted = inside.withColumn("_shift", shift).groupBy(*renamed.columns, section.alias("_section")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
    )
    upto = Window.partitionBy(*[f"_{c}" for c in (*by, "rank")]).orderBy("_section")  # at most 1,024 rows
    reached = counted.withColumn("_cum", F.col("_below") + F.sum("_c").over(upto)).filter("_cum > _at")
    first = reached.groupBy(*renamed.columns).agg(
        F.min_by(F.struct("_least", "_most", (F.col("_cum") - F.col("_c")).alias("_before")), "_section").alias("_to")
    )
    kept = [F.col(f"_{c}").alias(c) for c in (*by, "rank", "n", "at")]
    return first.select(
        *kept, F.col("_to._least").alias("low"), F.col("_to._most").alias("high"), F.col("_to._before").alias("below")
    )


def order_statistics(values: DataFrame, by: list[str], value: str = "x", few_groups: bool = False) -> DataFrame:
    """(by..., n, median, p95) per group, exact; null values do not count, a null key is a group of its own.

    ``few_groups`` says that the number of groups is a known small constant,
    so the table of ranges may be broadcast; otherwise Spark decides by size.
    """
    keys = by or ["_all"]
    if not by:
        values = values.withColumn("_all", F.lit(0))
    number = F.col(value).cast("double")
    values = stored(values.filter(number.isNotNull()).select(*keys, _as_order(number).alias("_x")), "values")
    spans = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    ranks = [F.struct(F.lit(r).alias("rank"), _rank_index(r, F.col("n")).alias("at")) for r in _RANKS]
    wanted = stored(
        spans.select(*keys, F.inline(F.array(*ranks)), "n", "low", "high", F.lit(0).cast("bigint").alias("below"))
        .select(*keys, "rank", "n", "at", "low", "high", "below"), "ranges",
    )
    while not (still := wanted.filter("low < high")).isEmpty():
        wanted = stored(
            wanted.filter("low = high").unionByName(_narrowed(values, still, keys, few_groups)), "ranges"
        )
    found = wanted.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("rank") == r, F.col("low"))).alias(r) for r in _RANKS])
    value = {r: _as_double(F.col(r)) for r in _RANKS}
    median = (value["mid_low"] + value["mid_high"]) / F.lit(2.0)
    return found.select(*by, "n", median.alias("median"), value["p95"].alias("p95"))


def _arms(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.lit("manual").alias("arm"), F.col("manual_minutes").cast("double").alias("x")),
                F.struct(F.lit("ai").alias("arm"), F.col("ai_minutes").cast("double").alias("x")),
            )
        ),
    )


def ab_report(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sample count, median and nearest-rank p95 of both arms, median reduction.

    Without ``by`` the result is one row, with zeros when there are no samples.
    """
    by = by or []
    stats = order_statistics(_arms(samples, by), [*by, "arm"], few_groups=not by)
    arm = lambda a, c: F.coalesce(F.max(F.when(F.col("arm") == a, F.col(c))), F.lit(0.0))
    flat = stats.groupBy(*by).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("samples"),
        arm("manual", "median").alias("manual_p50_min"),
        arm("ai", "median").alias("ai_p50_min"),
        arm("manual", "p95").alias("manual_p95_min"),
        arm("ai", "p95").alias("ai_p95_min"),
    )
    manual, ai = F.col("manual_p50_min"), F.col("ai_p50_min")
    return flat.withColumn(
        "time_reduction_p50", F.when(manual != 0, (manual - ai) / manual).otherwise(F.lit(0.0))
    )
