"""Rule classifier: an ordered catalogue folded into one CASE WHEN of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.labels import UNKNOWN, UNKNOWN_CONFIDENCE
from ..catalog.rules import KEY_WORDS, RULES, UNKNOWN_EXPLANATION
from .linescan import any_match, fold_case
from .textforms import let, once

RESULT_TYPE = "struct<label:string,explanation:string,confidence:double>"


def result(label: str, explanation: str | Column, confidence: float) -> Column:
    text = F.lit(explanation) if isinstance(explanation, str) else explanation
    return F.struct(
        F.lit(label).alias("label"),
        text.alias("explanation"),
        F.lit(float(confidence)).alias("confidence"),
    )


def first_rule(folded: Column, rules=RULES, known: dict[str, Column] | None = None) -> Column:
    """Position (0-based) of the first rule that fits; ``len(rules)`` when none does."""
    chain = None
    for position, rule in enumerate(rules):
        test = any_match(folded, rule.patterns, known)
        chain = F.when(test, position) if chain is None else chain.when(test, position)
    return chain.otherwise(len(rules))


def verdict_at(position: Column, rules=RULES) -> Column:
    """Verdict struct of a rule position: a look-up in a constant array."""
    verdicts = [result(r.label, r.explanation, r.confidence) for r in rules]
    verdicts.append(result(UNKNOWN, UNKNOWN_EXPLANATION, UNKNOWN_CONFIDENCE))
    return F.get(F.array(*verdicts), position)


def classify_log(log: Column) -> Column:
    """Verdict struct as one Column, e.g. for views; missing text counts as empty."""
    text = F.coalesce(log, F.lit(""))
    return let({"t": fold_case(text)}, lambda b: verdict_at(first_rule(b["t"])))


def with_verdict(df: DataFrame, log: str = "log", out: str = "verdict") -> DataFrame:
    """Add the verdict struct; the text is folded once and the rule chain runs once."""
    folded = df.withColumn("_folded", fold_case(F.coalesce(F.col(log), F.lit(""))))
    words = {f"_has_{w}": F.contains(F.col("_folded"), F.lit(w)) for w in KEY_WORDS}
    known = {w: F.col(f"_has_{w}") for w in KEY_WORDS}
    ruled = once(folded.withColumns(words), "_rule", first_rule(F.col("_folded"), known=known))
    return ruled.withColumn(out, verdict_at(F.col("_rule"))).drop("_folded", "_rule", *words)
