"""Reproducible global shuffle into shards.

Rows get global numbers in the order of key columns; a keyed Feistel permutation
with cycle walking maps a number to its place, and the place gives shard and slot.
Given the number of rows, each row's shard and slot can be computed, and the row
of a slot too, without moving or counting other rows.

Numbers: rows are range-partitioned and sorted by the key, with the row's place in
the scan as last tie-break, so that equal rows, however many, spread over
partitions. Number = rows in lower partitions + place in the partition. Rows that
tie on all keys may swap numbers between runs; they are equal in the key columns.

Nulls sort first. An empty table gives an empty result. Columns of the input that
are named like an output column (shard, slot) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .feistel import permute

_PART_BITS = 33  # of monotonically_increasing_id: partition above, row in the partition below


def number_rows(rows: DataFrame, by: list[str], out: str) -> tuple[DataFrame, int]:
    """rows with their 0-based number in the order of ``by``, and how many there are."""
    scan, at, part, first = (f"{out}__{x}" for x in ("scan", "at", "part", "first"))
    keys = [*by, scan]
    ordered = (
        rows.drop(out).withColumn(scan, F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop(scan).withColumn(at, F.monotonically_increasing_id())
    )
    table = stored(ordered, "ordered").withColumn(part, F.shiftrightunsigned(at, _PART_BITS))
    # one row per partition, as Spark's driver itself keeps
    sizes = table.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        sizes.select(part, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)), "offsets"
    )
    total = offsets.agg(F.sum("n")).first()[0] or 0
    inside = F.col(at) - F.shiftleft(F.col(part), _PART_BITS)
    numbered = table.join(F.broadcast(offsets.drop("n")), part).withColumn(out, F.col(first) + inside)
    return numbered.drop(at, part, first), total


def place(number: Column, n: int, shards: int, seed: str) -> Column:
    """Struct (shard, slot) of a row number: counts differ by one at most, slots have no gap."""
    return F.transform(
        F.array(permute(number, n, seed)),
        lambda to: F.struct(
            (to % shards).cast("int").alias("shard"), F.floor(to / shards).cast("bigint").alias("slot")
        ),
    )[0]


def shuffle_into_shards(
    rows: DataFrame, by: list[str], shards: int = 8, seed: str = "shards"
) -> DataFrame:
    """rows with ``shard`` int and ``slot`` bigint."""
    number = "_row_number"
    while number in rows.columns:
        number += "_"
    numbered, n = number_rows(rows.drop("shard", "slot"), by, number)
    placed = numbered.withColumn(number, place(F.col(number), n, shards, seed))
    return placed.select("*", f"{number}.shard", f"{number}.slot").drop(number)
