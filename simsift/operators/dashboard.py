"""Markdown dashboard as ordered lines, from one-row report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textforms import fixed, percent
from .evaluate import mean_accuracy

Line = tuple[int, Column]


def _lines(report: DataFrame, lines: list[Line]) -> DataFrame:
    """(line_no, line) rows out of a one-row report."""
    structs = [F.struct(F.lit(no).alias("line_no"), text.alias("line")) for no, text in lines]
    return report.select(F.inline(F.array(*structs)))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _quality(report: DataFrame, title: str, start: int) -> DataFrame:
    counted = F.concat(
        F.lit("- Accuracy: "), percent(_or_zero("accuracy")), F.lit(" ("),
        F.coalesce("correct", F.lit(0)).cast("string"), F.lit("/"),
        F.coalesce("total", F.lit(0)).cast("string"), F.lit(")"),
    )
    unknown = F.concat(F.lit("- Unknown Rate: "), percent(_or_zero("unknown_rate")))
    return _lines(
        report,
        [(start, F.lit(title)), (start + 1, counted), (start + 2, unknown), (start + 3, F.lit(""))],
    )


def _ab(report: DataFrame, start: int) -> DataFrame:
    minutes = lambda text, name: F.concat(F.lit(text), fixed(_or_zero(name), 2))
    samples = F.coalesce("samples", F.lit(0)).cast("string")
    return _lines(
        report,
        [
            (start, F.lit("## A/B Pilot")),
            (start + 1, F.concat(F.lit("- Samples: "), samples)),
            (start + 2, minutes("- Median Manual Minutes: ", "manual_p50_min")),
            (start + 3, minutes("- Median AI Minutes: ", "ai_p50_min")),
            (start + 4, minutes("- P95 Manual Minutes: ", "manual_p95_min")),
            (start + 5, minutes("- P95 AI Minutes: ", "ai_p95_min")),
            (start + 6, F.concat(F.lit("- Median Time Reduction: "),
                                 percent(_or_zero("time_reduction_p50")))),
            (start + 7, F.lit("")),
        ],
    )


def dashboard_lines(
    spark: SparkSession,
    eval_report: DataFrame | None = None,
    natural_report: DataFrame | None = None,
    ab_report: DataFrame | None = None,
) -> DataFrame:
    """(line_no, line), at most 27 rows; sections of missing reports are left out."""
    frame = spark.range(0, 1, 1, 1)
    parts = [_lines(frame, [(0, F.lit("# Metrics Dashboard")), (1, F.lit(""))])]
    if eval_report is not None:
        parts.append(_quality(eval_report, "## Model Eval", 10))
    if natural_report is not None:
        parts.append(_quality(natural_report, "## Natural Bug Sanity Check", 20))
    if ab_report is not None:
        parts.append(_ab(ab_report, 30))
    known = [r for r in (eval_report, natural_report) if r is not None]
    if known:
        text = F.concat(
            F.lit("- Mean Accuracy Across Available Reports: "),
            percent(F.col("mean_accuracy")),
        )
        parts.append(
            _lines(
                mean_accuracy(*known),
                [(40, F.lit("## Portfolio Health")), (41, text), (42, F.lit(""))],
            )
        )
    parts.append(_lines(frame, [(50, F.lit("_Generated from the stored reports._"))]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
