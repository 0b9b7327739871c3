"""The rule classifier as a function of SQL.

The body is the rule chain of the catalogue as one SQL expression, which the planner puts in place of
the call: no Python, no view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog.labels import UNKNOWN, UNKNOWN_CONFIDENCE
from ..catalog.rules import RULES, UNKNOWN_EXPLANATION
from .linescan import guards, is_literal, linear_regex


def _text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _match(alternative: str) -> str:
    tests = [f"contains(t, {_text(g)})" for g in guards(alternative)]
    if not is_literal(alternative):
        tests.append(f"t RLIKE {_text(linear_regex(alternative))}")
    return " AND ".join(tests)


def _verdict(label: str, explanation: str, confidence: float) -> str:
    return f"named_struct('label', {_text(label)}, 'explanation', {_text(explanation)}, 'confidence', {float(confidence)!r}D)"


def rule_expression(log: str) -> str:
    """SQL expression of the verdict on a text column; a missing text counts as empty."""
    cases = " ".join(
        f"WHEN {' OR '.join(f'({_match(a)})' for a in rule.patterns)} THEN {_verdict(rule.label, rule.explanation, rule.confidence)}"
        for rule in RULES
    )
    folded = (
        f"CASE WHEN contains({log}, 'ſ') OR contains({log}, 'ı') OR contains({log}, 'İ') "
        f"THEN lower(translate({log}, 'ſıİ', 'siI')) ELSE lower(coalesce({log}, '')) END"
    )
    other = _verdict(UNKNOWN, UNKNOWN_EXPLANATION, UNKNOWN_CONFIDENCE)
    return f"transform(array({folded}), t -> CASE {cases} ELSE {other} END)[0]"


def create_classifier(spark: SparkSession, name: str = "classify_log") -> None:
    """A temporary function of the session: ``SELECT classify_log(text).label FROM any_table``."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(log STRING) "
        "RETURNS STRUCT<label: STRING, explanation: STRING, confidence: DOUBLE> "
        f"RETURN {rule_expression('log')}"
    )
