"""Triage of log requests: size check, tail cut, verdict, confidence gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.formats import BREAKER_OPEN_DETAIL, TOO_LONG_DETAIL
from ..catalog.labels import CONFIDENCE_THRESHOLD
from ..functions.classify import RESULT_TYPE, with_verdict
from ..functions.generated import strict_verdict
from ..functions.textforms import once
from ..functions.triage import gate, keep_tail, too_long
from ..sources.readers import read_log_files


def judged(requests: DataFrame, key: str = "id", log: str = "log", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``_long``, ``_rules``): the size check and the rules' verdict on the cut log, without the text.

    What is joined afterwards are these narrow rows; a log never takes part in an exchange.
    """
    text = F.col(log)
    rows = requests.select(
        key, *keep, too_long(text).alias("_long"), F.when(~too_long(text), keep_tail(text)).alias("_cut")
    )
    return with_verdict(rows, "_cut", "_rules").select(key, *keep, "_long", "_rules")


def model_or_rules(logs: DataFrame, generated: DataFrame, key: str = "id", log: str = "log") -> DataFrame:
    """(key, verdict): the generated JSON where there is a complete one for the key, else the rules on the log."""
    rules = with_verdict(logs.select(key, F.col(log).alias("_log")), "_log", "_rules").select(key, "_rules")
    rows = rules.join(generated.select(key, "generated_text"), key, "left")
    return rows.select(key, F.coalesce(strict_verdict(F.col("generated_text")), F.col("_rules")).alias("verdict"))


def answered(rows: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, key: str = "id") -> DataFrame:
    """Answers from judged rows with ``route``, ``status`` and ``generated_text`` (null: the rules answer)."""
    model = strict_verdict(F.when(F.col("route") == "model", F.col("generated_text")))
    status = F.when(F.col("_long"), 400).otherwise(F.coalesce("status", F.lit(200)))
    chosen = rows.withColumns({"_chosen": F.coalesce(model, F.col("_rules")), "_status": status})
    answer = F.when(F.col("_status") == 200, gate(F.col("_chosen"), threshold)).cast(RESULT_TYPE)
    detail = (
        F.when(F.col("_status") == 400, F.lit(TOO_LONG_DETAIL))
        .when(F.col("_status") == 503, F.lit(BREAKER_OPEN_DETAIL))
        .when(F.col("_status") == 502, F.lit("Call to the model failed"))
    )
    gated = once(chosen, "_answer", answer)
    return gated.select(key, F.col("_status").alias("status"), "_answer.*", detail.alias("detail"))


def triage(
    requests: DataFrame,
    routed: DataFrame | None = None,
    generated: DataFrame | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
    key: str = "id",
) -> DataFrame:
    """Verdict or error per request: (key, status, label, explanation, confidence, detail).

    Without ``routed`` and ``generated`` only the rules answer. With them,
    ``routed(key, route, status)`` says who answers each request and
    ``generated(key, generated_text)`` holds the model's text.
    """
    rows = judged(requests, key)
    if routed is None or generated is None:
        nothing = {"route": F.lit(None).cast("string"), "status": F.lit(None).cast("int"), "generated_text": F.lit(None).cast("string")}
        return answered(rows.withColumns(nothing), threshold, key)
    rows = rows.join(routed.select(key, "route", "status"), key, "left")
    return answered(rows.join(generated.select(key, "generated_text"), key, "left"), threshold, key)


def accepted(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("status") == 200).drop("status", "detail")


def rejected(triaged: DataFrame, key: str = "id") -> DataFrame:
    return triaged.filter(F.col("status") != 200).select(key, "status", "detail")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, explanation, confidence) for log files: rules only, no cut, no gate."""
    return with_verdict(read_log_files(spark, path)).select("file", "verdict.*")
