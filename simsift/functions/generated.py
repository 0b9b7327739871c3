"""Verdicts read out of generated text that should hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.labels import UNKNOWN
from .textforms import strip


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def json_window(text: Column) -> Column:
    """Trimmed text, cut to the outermost braces where it does not start or end with them."""
    body = strip(text)
    head = F.when(
        ~F.startswith(body, F.lit("{")) & F.contains(body, F.lit("{")),
        F.substr(body, F.locate("{", body)),
    ).otherwise(body)
    last = F.length(head) - F.locate("}", F.reverse(head)) + F.lit(1)
    return F.when(
        ~F.endswith(head, F.lit("}")) & F.contains(head, F.lit("}")), F.left(head, last)
    ).otherwise(head)


def _member(doc: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(doc, F.lit("$." + key), kind)


def strict_verdict(text: Column) -> Column:
    """Verdict struct, or null unless the JSON object has all three keys."""
    window = json_window(text)
    doc = _parsed(window)
    keys = F.json_object_keys(window)
    complete = (
        doc.isNotNull()
        & F.array_contains(keys, "label")
        & F.array_contains(keys, "explanation")
        & F.array_contains(keys, "confidence")
    )
    return F.when(
        complete,
        F.struct(
            _member(doc, "label", "string").alias("label"),
            _member(doc, "explanation", "string").alias("explanation"),
            _member(doc, "confidence", "double").alias("confidence"),
        ),
    )


def lenient_label(text: Column) -> Column:
    """Label between the outermost braces; Unknown when there is none."""
    body = strip(text)
    start = F.locate("{", body)
    end = F.length(body) - F.locate("}", F.reverse(body)) + F.lit(1)
    usable = F.contains(body, F.lit("{")) & F.contains(body, F.lit("}")) & (end > start)
    window = F.when(usable, F.substr(body, start, end - start + F.lit(1)))
    return F.coalesce(_member(_parsed(window), "label", "string"), F.lit(UNKNOWN))
