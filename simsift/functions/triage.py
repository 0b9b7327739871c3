"""Request-level projections: size check, tail cut, gate, prompts, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import formats as T
from ..catalog.labels import CONFIDENCE_THRESHOLD, KEEP_LOG_CHARS, MAX_LOG_CHARS, UNKNOWN
from .textforms import fixed


def too_long(log: Column) -> Column:
    return F.coalesce(F.length(log) > F.lit(MAX_LOG_CHARS), F.lit(False))


def keep_tail(log: Column) -> Column:
    """Cut to the last characters behind a marker; cutting twice changes nothing more."""
    return F.when(
        F.length(log) > KEEP_LOG_CHARS,
        F.concat(F.lit(T.TRUNCATION_MARKER), F.right(log, F.lit(KEEP_LOG_CHARS))),
    ).otherwise(log)


def gate(verdict: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """Replace verdicts below the threshold by Unknown; the confidence stays."""
    sure = F.coalesce(verdict["confidence"], F.lit(0.0))
    limit = F.lit(float(threshold))
    text = F.concat(
        F.lit("Low-confidence classification ("), fixed(sure, 2), F.lit(" < "), fixed(limit, 2),
        F.lit("). Check manually."),
    )
    low = F.struct(
        F.lit(UNKNOWN).alias("label"), text.alias("explanation"), sure.alias("confidence")
    )
    return F.when(sure >= limit, verdict).otherwise(low)


def prompt(log: Column) -> Column:
    return F.concat(F.lit(T.PROMPT_HEAD), F.coalesce(log, F.lit("")), F.lit(T.PROMPT_TAIL))


def target_json(label: Column, explanation: Column, confidence: Column) -> Column:
    """Compact JSON target with the usual defaults for missing fields."""
    return F.to_json(
        F.struct(
            F.coalesce(label, F.lit(UNKNOWN)).alias("label"),
            F.coalesce(explanation, F.lit(T.NO_EXPLANATION)).alias("explanation"),
            F.coalesce(confidence.cast("double"), F.lit(1.0)).alias("confidence"),
        )
    )


def instruct_text(prompt_text: Column, target: Column) -> Column:
    return F.concat(
        F.lit(T.INSTRUCT_OPEN), prompt_text, F.lit(T.INSTRUCT_MIDDLE), target,
        F.lit(T.INSTRUCT_CLOSE),
    )
