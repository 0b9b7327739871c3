"""Evaluation of predicted labels: rates, confusion, details, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.labels import UNKNOWN
from ..functions.classify import with_verdict
from ..functions.textforms import rounded


def with_prediction(rows: DataFrame) -> DataFrame:
    """Add expected, predicted, confidence from ``log`` and ``label``; null means missing."""
    scored = with_verdict(rows)
    return scored.withColumns(
        {
            "expected": F.coalesce("label", F.lit(UNKNOWN)),
            "predicted": F.col("verdict.label"),
            "confidence": F.col("verdict.confidence"),
        }
    ).drop("verdict")


def _rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def accuracy_report(scored: DataFrame, same: Column | None = None) -> DataFrame:
    """One row: total, correct, accuracy, unknown_rate; rates are 0.0 on empty input."""
    same = F.col("predicted") == F.col("expected") if same is None else same
    counts = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(same).alias("correct"),
        F.count_if(F.col("predicted") == UNKNOWN).alias("_unknown"),
    )
    return counts.select(
        "total", "correct",
        _rate(F.col("correct"), F.col("total")).alias("accuracy"),
        _rate(F.col("_unknown"), F.col("total")).alias("unknown_rate"),
    )


def ignoring_case() -> Column:
    return F.lower("predicted") == F.lower("expected")


def confusion(scored: DataFrame) -> DataFrame:
    """(expected, predicted, n): one row per pair that occurs."""
    return scored.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def most_common_first(pairs: DataFrame) -> DataFrame:
    """Sort for output: inside each expected label by count, then name."""
    return pairs.orderBy("expected", F.desc("n"), "predicted")


def confusion_document(pairs: DataFrame) -> DataFrame:
    """One row with the nested map expected -> predicted -> n (labels squared at most)."""
    inner = pairs.groupBy("expected").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "predicted", "n"))),
                lambda e: F.struct(e["predicted"], e["n"]),
            )
        ).alias("_row")
    )
    named = F.map_from_entries(F.collect_list(F.struct("expected", "_row")))
    return inner.agg(named.alias("confusion"))


def details(scored: DataFrame, *extra: str) -> DataFrame:
    """Per-row report: id, expected, predicted, confidence and any extra columns."""
    return scored.select(
        F.coalesce(F.col("id").cast("string"), F.lit("unknown")).alias("id"),
        "expected", "predicted", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *extra,
    )


def join_predictions(expected: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Expected labels with predictions of the same id (equi-join on a unique id)."""
    return expected.join(predictions, key, "inner")


def speed_report(runs: DataFrame) -> DataFrame:
    """Mean latency (3 decimals) and mean tokens per second (1 decimal)."""
    rate = F.when(F.col("elapsed_s") > 0, F.col("n_tokens") / F.col("elapsed_s")).otherwise(0.0)
    means = runs.agg(
        F.coalesce(F.avg("elapsed_s"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("speed"),
    )
    return means.select(
        rounded(F.col("lat"), 3).alias("avg_latency_s"),
        rounded(F.col("speed"), 1).alias("avg_tokens_per_sec"),
    )


def label_distribution(rows: DataFrame) -> DataFrame:
    """(label, n); order it by label or by count where it is shown."""
    return rows.groupBy(F.coalesce("label", F.lit(UNKNOWN)).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def mean_accuracy(*reports: DataFrame) -> DataFrame:
    """Mean accuracy over the reports that are there."""
    rows = reports[0].select("accuracy")
    for report in reports[1:]:
        rows = rows.unionByName(report.select("accuracy"))
    return rows.agg(F.avg("accuracy").alias("mean_accuracy"))
