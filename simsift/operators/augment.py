"""Seeded augmentation: every row kept, plus n noisy variants of it.

One pass: the row is exploded into positions -1 (the row itself) to n-1, so
base rows and variants come out of a single scan without a union or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.labels import MODULES, UNKNOWN
from ..catalog.templates import LABEL_LINES, NOISE_LINES, OTHER_LABEL_LINE, SUFFIX_LINES
from ..functions.draws import choice, choose, fill, marks_in, with_draws
from ..functions.textforms import once
from .lookups import with_label_lines

MAX_NOISE = 4


_NOISE_MARKS, _SUFFIX_MARKS = marks_in(NOISE_LINES), marks_in(SUFFIX_LINES)
_LABEL_MARKS = marks_in([t for lines in LABEL_LINES.values() for t in lines] + [OTHER_LABEL_LINE])
_NOISE_SLOTS = [f"noise{i}" for i in range(1, MAX_NOISE + 1)]


def with_variant_draws(rows: DataFrame, seed: int, key: Column) -> DataFrame:
    """Draws of a variant: is it noisy and how much, its lines, suffix and module."""
    rows = with_draws(rows, seed, key, {"noise": None})
    # 0 for half of the rows, else 1 to 4.
    count = F.when(choice("noise", 2) == 1, F.col("_noise_a") % MAX_NOISE + 1).otherwise(0)
    rows = rows.withColumn("_noise_count", count)
    lines = {slot: F.col("_noise_count") >= i for i, slot in enumerate(_NOISE_SLOTS, start=1)}
    return with_draws(rows, seed, key, {**lines, "line": None, "suffix": None, "module": None})


def noise_prefix() -> Column:
    """Up to 4 noise lines, each ended by a line break."""
    lines = [
        F.when(
            F.col("_noise_count") >= i,
            F.concat(fill(choose(NOISE_LINES, slot), slot, _NOISE_MARKS), F.lit("\n")),
        ).otherwise("")
        for i, slot in enumerate(_NOISE_SLOTS, start=1)
    ]
    return F.concat(*lines)


def assertion_line(lines: Column) -> Column:
    """One of the label's phrasings, filled."""
    return fill(F.get(lines, choice("line", F.size(lines))), "line", _LABEL_MARKS)


def suffix_line() -> Column:
    return fill(choose(SUFFIX_LINES, "suffix"), "suffix", _SUFFIX_MARKS)


def module_stamp() -> Column:
    return choose(MODULES, "module")


def number_variants(rows: DataFrame, n_aug: int) -> DataFrame:
    """Explode each row to ``_copy`` = -1 (itself), 0, ..., n_aug - 1."""
    if n_aug < 0:
        raise ValueError("n_aug must not be negative")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(-1), F.lit(n_aug - 1))))


def augment(rows: DataFrame, key: list[str], n_aug: int = 16, seed: int = 42) -> DataFrame:
    """Base rows and ``n_aug`` variants of each.

    ``key`` columns identify a row; same seed and keys give the same output.
    Variants carry ``augmented`` and ``aug_id`` (null on base rows), a new log
    and a module stamp; label, explanation and mutation_id are kept.
    """
    rows = rows.withColumn("label", F.coalesce(F.col("label"), F.lit(UNKNOWN)))
    if "module" not in rows.columns:
        rows = rows.withColumn("module", F.lit(None).cast("string"))
    spread = number_variants(with_label_lines(rows), n_aug)
    copy = F.col("_copy")
    own = F.concat_ws(":", *[F.col(k).cast("string") for k in key], copy.cast("string"))
    variant = copy >= 0
    drawn = with_variant_draws(spread, seed, own)
    drawn = once(drawn, "_prefix", F.when(variant, noise_prefix()))
    log = F.concat(F.col("_prefix"), assertion_line(F.col("lines")), F.lit("\n"), suffix_line())
    return drawn.select(
        *[F.col(c) for c in rows.columns if c not in ("log", "module")],
        F.when(variant, log).otherwise(F.col("log")).alias("log"),
        F.when(variant, module_stamp()).otherwise(F.col("module")).alias("module"),
        F.when(variant, F.lit(True)).alias("augmented"),
        F.when(variant, copy).alias("aug_id"),
    )
