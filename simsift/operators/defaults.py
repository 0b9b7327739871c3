"""Defaults of missing fields, by what the rows are used for. Null counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.formats import NO_EXPLANATION
from ..catalog.labels import UNKNOWN
from .positions import with_position

# --- fixed values: defaults by use; {n} is the row's index from 0 ----------
COMMON = {"log": "", "label": UNKNOWN}
USES = {
    "natural": {"id": "unknown", "confidence": 0.0},
    "evaluation": {"id": "test_{n}", "confidence": 0.0},
    "benchmark": {"id": "{n}", "confidence": 0.0},
    "training": {"explanation": NO_EXPLANATION, "confidence": 1.0},
}


def with_defaults(rows: DataFrame, use: str, order: list[str] | None = None) -> DataFrame:
    """rows with the missing values of the columns they have filled in.

    ``order`` names the columns whose order gives rows their index, where the use's id holds one. The benchmark numbers
    its rows whether they have an id or not. Column types stay, but for ``id``, which becomes text.
    """
    wanted = COMMON | USES[use]
    indexed = "{n}" in str(wanted.get("id", ""))
    if indexed:
        if not order:
            raise ValueError(f"use {use!r} numbers rows: give the columns of their order")
        rows = with_position(rows, order, "_n")

    def filled(name: str) -> Column:
        if name not in wanted:
            return F.col(name)
        default = wanted[name]
        if name == "id" and indexed:
            head = default.removesuffix("{n}")
            number = F.concat(F.lit(head), (F.col("_n") - 1).cast("string"))
            return F.coalesce(F.col("id").cast("string"), number) if head else number
        own = F.col(name).cast("string") if name == "id" else F.col(name)
        return F.coalesce(own, F.lit(default))

    return rows.select(*[filled(c).alias(c) for c in rows.columns if c != "_n"])
