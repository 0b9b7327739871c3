"""Training pairs: prompt, JSON target and the joined instruct text per labelled row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.triage import instruct_text, prompt, target_json


def training_pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., prompt, target, text) from log, label, explanation and confidence.

    An empty input raises; one row is enough to know that it is not.
    """
    if rows.isEmpty():
        raise ValueError("no rows to build training pairs from")
    pairs = rows.select(
        *keep,
        prompt(F.col("log")).alias("prompt"),
        target_json(F.col("label"), F.col("explanation"), F.col("confidence")).alias("target"),
    )
    return pairs.withColumn("text", instruct_text(F.col("prompt"), F.col("target")))
