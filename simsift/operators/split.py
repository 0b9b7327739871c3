"""Exact stratified train/val/test split without moving the wide rows.

Ranks inside a label follow the md5 of (seed, row key). A label may hold a
third of all rows, so no task ever sorts a whole label: rows are counted per
(label, hash prefix), the prefix that holds each cut rank is found from the
counts, and only the narrow keys of those prefixes are ranked. The result is
one small row of cut keys per label; the wide rows then just compare their own
key with it.

Prefixes are as long as a label's count asks for, so that a range has at most about a quarter of ``limit``
rows on average and, as md5 spreads evenly, hardly ever more than ``limit``. The rows before a
range are summed up in a tree of three digits a level: no window sees more than 4,096 ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.labels import UNKNOWN
from ..session import stored
from .positions import with_position

#: Rows a window may hold, but for rows that share one key.
LIMIT = 1 << 16
_STEP = 3  # digits of a level: 4,096 ranges below each


def shuffle_key(key: list[str], seed: int) -> Column:
    """Seeded pseudo-random, unique order key of a row: md5, then the key itself."""
    own = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), own).cast("binary")), own)


def split_sizes(n: Column, train_ratio: float, val_ratio: float) -> dict[str, Column]:
    """``n_train`` and ``n_val`` of a label with ``n`` rows (half-even rounding)."""
    one = F.lit(1).cast("bigint")
    share = lambda r: F.greatest(one, F.rint(n * F.lit(float(r))).cast("bigint"))
    train, val = share(train_ratio), share(val_ratio)
    fits = n - train - val >= 0
    return {
        "n_train": F.when(fits, train).otherwise(F.greatest(one, n - F.lit(2))),
        "n_val": F.when(fits, val).otherwise(F.when(n > 1, one).otherwise(F.lit(0).cast("bigint"))),
    }


def _keyed(rows: DataFrame, key: list[str], label: str, seed: int, limit: int, *keep: str) -> tuple[DataFrame, int]:
    """(_label, _order, _range, _total, keep...) of each row, and the digits of the longest range."""
    keys = rows.select(F.coalesce(F.col(label), F.lit(UNKNOWN)).alias("_label"), shuffle_key(key, seed).alias("_order"), *keep)
    fold = F.log(16.0, F.col("_total") / F.lit(limit / 4))
    totals = stored(
        keys.groupBy("_label").agg(F.count(F.lit(1)).alias("_total"))
        .withColumn("_digits", F.greatest(F.lit(0), F.ceil(fold)).cast("int")), "totals",
    )
    digits = totals.agg(F.max("_digits")).first()[0] or 0
    ranged = keys.join(totals, "_label").withColumn("_range", F.expr("substring(_order, 1, _digits)"))
    return ranged.drop("_digits"), digits


def _range_offsets(counts: DataFrame, digits: int) -> DataFrame:
    """counts (_label, _range, _n) with ``_before``, the rows of the label in lower ranges."""
    if digits == 0:
        return counts.withColumn("_before", F.lit(0).cast("bigint"))
    upper = F.expr(f"substring(_range, 1, greatest(0, length(_range) - {_STEP}))").alias("_upper")
    levelled = counts.withColumn("_upper", upper)
    above = _range_offsets(
        levelled.groupBy("_label", F.col("_upper").alias("_range")).agg(F.sum("_n").alias("_n")), max(0, digits - _STEP)
    ).select("_label", F.col("_range").alias("_upper"), F.col("_before").alias("_above"))
    upto = Window.partitionBy("_label", "_upper").orderBy("_range")
    inside = levelled.withColumn("_inside", F.sum("_n").over(upto) - F.col("_n"))
    before = F.col("_above") + F.col("_inside")
    return inside.join(above, ["_label", "_upper"]).withColumn("_before", before).drop("_upper", "_above", "_inside")


def label_ranks(
    rows: DataFrame, key: list[str], label: str = "label", seed: int = 42, limit: int = LIMIT,
) -> DataFrame:
    """Seeded shuffle inside each label: (label, key..., rank from 1), narrow columns only."""
    keyed, digits = _keyed(rows, key, label, seed, limit, *key)
    counts = keyed.groupBy("_label", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _range_offsets(counts, digits).select("_label", "_range", "_before")
    local = F.row_number().over(Window.partitionBy("_label", "_range").orderBy("_order"))
    ranked = keyed.withColumn("_local", local).join(offsets, ["_label", "_range"])
    return ranked.select(
        F.col("_label").alias(label), *key, (F.col("_before") + F.col("_local")).alias("rank")
    )


def _cut_keys(keys: DataFrame, digits: int, train_ratio: float, val_ratio: float) -> DataFrame:
    """Per label the order keys of the last train row and of the last val row."""
    counts = keys.groupBy("_label", "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"))
    offsets = _range_offsets(counts, digits)
    sizes = split_sizes(F.col("_total"), train_ratio, val_ratio)
    cuts = offsets.withColumns(sizes).select(
        "_label", "_range", "_before", "_n",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("cut"), F.col("n_train").alias("at")),
                F.struct(F.lit("val").alias("cut"), (F.col("n_train") + F.col("n_val")).alias("at")),
            )
        ).alias("_c"),
    )
    # The range holding the cut rank; a cut past the end takes the last range.
    holds = cuts.filter(
        (F.col("_before") < F.col("_c.at")) & (F.col("_c.at") <= F.col("_before") + F.col("_n"))
    ).select(
        "_label", "_range", F.col("_c.cut").alias("_cut"),
        (F.col("_c.at") - F.col("_before")).alias("_local_at"),
    )
    wanted = holds.groupBy("_label", "_range").agg(
        F.map_from_entries(F.collect_list(F.struct("_cut", "_local_at"))).alias("_cuts")
    )
    inside = Window.partitionBy("_label", "_range").orderBy("_order")
    ranked = keys.join(wanted, ["_label", "_range"]).withColumns(
        {"_rank": F.row_number().over(inside), "_next": F.lead("_order").over(inside)}
    )
    at_cut = lambda c: F.col("_rank") == F.try_element_at("_cuts", F.lit(c))
    unclear = F.raise_error(F.lit("split key is not unique: give columns that identify a row"))
    order = F.when(F.col("_next") == F.col("_order"), unclear).otherwise(F.col("_order"))
    return (
        ranked.filter(at_cut("train") | at_cut("val"))
        .groupBy("_label")
        .agg(
            F.max(F.when(at_cut("train"), order)).alias("_last_train"),
            F.max(F.when(at_cut("val"), order)).alias("_last_val"),
        )
    )


def stratified_split(
    rows: DataFrame,
    key: list[str],
    label: str = "label",
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    seed: int = 42,
    limit: int = LIMIT,
) -> DataFrame:
    """Add ``split`` (train/val/test): an exact partition of the rows per label.

    ``key`` columns must identify a row. The cut keys are stored before the join: one row per
    label, whose file size Spark knows when it plans. So it broadcasts them and the wide rows
    stay where they are; only with very many labels it shuffles, and splits a hot one (AQE).
    """
    cuts = stored(_cut_keys(*_keyed(rows, key, label, seed, limit), train_ratio, val_ratio), "cuts")
    out = rows.withColumn("_order", shuffle_key(key, seed)).withColumn(
        "_label", F.coalesce(F.col(label), F.lit(UNKNOWN))
    )
    # A cut rank beyond the label (only train or val rows) has no key: all rows are before it.
    before = lambda c: F.col(c).isNull() | (F.col("_order") <= F.col(c))
    split = F.when(before("_last_train"), "train").when(before("_last_val"), "val").otherwise("test")
    return out.join(cuts, "_label").withColumn("split", split).select(*rows.columns, "split")


def shuffled(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Final order of each split: rows sorted by (split, seeded key), with their ``position`` from 1 in the whole table."""
    ordered = with_position(rows.withColumn("_order", shuffle_key(key, seed)), ["split", "_order"])
    return ordered.drop("_order")
