"""Places of rows in a total order, without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_PART_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def with_position(rows: DataFrame, by: list[str], out: str = "position") -> DataFrame:
    """rows with their 1-based place in the order of ``by``.

    Rows are range-partitioned and sorted by the columns and stored; a place is that in the partition plus the rows of
    all lower partitions, from one count per partition. Rows that tie are numbered in any
    order. Ties are broken by the place in the scan, so that many equal rows spread over partitions.
    """
    keys = [*by, "_scan"]
    ordered = rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = stored(ordered.drop("_scan").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    table = table.withColumn("_part", F.shiftrightunsigned("_at", _PART_BITS))
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_first"))
    inside = F.col("_at") - F.shiftleft(F.col("_part"), _PART_BITS)
    placed = table.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_first") + inside + 1)
    return placed.drop("_at", "_part", "_first")
