"""Structured-first log parser: (label, explanation, confidence) with details.

Works in stages so that every costly text extraction is one projection and
runs only for rows that need it: the structured line, then the verdict from
its fields, then (only where that gave nothing) the free-text verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import labels as L
from . import logfields as LF
from .linescan import any_match, fold_case
from .textforms import once, pair_text

# --- fixed values: id tokens, patterns, labels, confidences, in test order --


@dataclass(frozen=True)
class IdRule:
    tokens: tuple[str, ...]
    label: str
    confidence: float


STRUCTURED_IDS = (
    IdRule(("overflow", "counter", "boundary", "baud"), L.OFF_BY_ONE, 0.92),
    IdRule(("handshake", "backpressure", "ready", "cs_deasserted", "ready_stuck", "nack"), L.HANDSHAKE, 0.90),
    IdRule(("parity", "idle_high", "uart"), L.PARITY, 0.88),
    IdRule(("enable", "polarity", "wr_en", "rd_en"), L.ENABLE, 0.88),
    IdRule(("irq_stuck", "irq", "gpio"), L.ENABLE, 0.82),
)
FALLBACK_IDS = (
    IdRule(("overflow", "counter", "boundary", "baud"), L.OFF_BY_ONE, 0.78),
    IdRule(("handshake", "backpressure", "ready", "nack", "cs"), L.HANDSHAKE, 0.78),
    IdRule(("scoreboard", "mismatch", "data", "frame"), L.DATA_INTEGRITY, 0.75),
    IdRule(("parity", "uart", "idle"), L.PARITY, 0.73),
    IdRule(("enable", "polarity", "wr_en", "irq"), L.ENABLE, 0.73),
)
TEXT_COUNTER = (r"Counter overflow", r"BAUD.*overflow", r"bit.counter.*overflow")
TEXT_HANDSHAKE = (r"Backpressure violation", r"write_fire=1\s+ready=0", r"CS_N deasserted",
                  r"ready_stuck", r"NACK.*received", r"protocol assertion")
TEXT_DATA = (r"SCOREBOARD_FAIL", r"Data mismatch", r"Unexpected data", r"frame.*mismatch")
TEXT_PARITY = (r"parity.*error", r"parity.*mismatch", r"frame.*integrity")
TEXT_ENABLE = (r"enable.*polarity", r"wr_en.*0", r"write.*while.*disabled", r"idle.*high.*tx")
COUNTER_VALUES = r"Counter overflow[^=]*?count[=:]?(\d+)[^@]*?at cycle (\d+)"
MISMATCH_VALUES = r"Data mismatch expected[=:]?(\w+)\s+actual[=:]?(\w+)\s+at cycle\s+(\d+)"

# Same matches as COUNTER_VALUES without its nested rescans: only the first
# start between two '=' and the first count between two '@' can succeed.
_COUNTER_LINEAR = (
    r"(?dU)(?:\A|=)(?>[^=]*?Counter overflow)(?>[^=@]*+@)*?"
    r"(?>[^=@]*?count[=:]?(\d+))(?>[^@]*?at cycle (\d+))"
)
_MISMATCH = "(?dU)" + MISMATCH_VALUES


# Explanation: the cause of the label, where it was seen, and the values found there.
CAUSES = {
    L.OFF_BY_ONE: "A count went beyond the range it was built for",
    L.HANDSHAKE: "One side of a transfer moved while the other had not agreed to it",
    L.DATA_INTEGRITY: "The data that came out differ from the model's",
    L.PARITY: "A serial frame came with wrong check bits or a wrong resting level",
    L.ENABLE: "A block worked, or did not, against its enable or mask",
    L.UNKNOWN: "The log shows none of the causes known here",
}
FROM_FIELDS, FROM_TEXT, FROM_ID, FROM_NOTHING = "structured line", "wording", "assertion id", "nothing"
DETAILS = ("assertion_id", "cycle", "count", "expected", "actual", "write_fire", "ready", "signals")

_FIELDS = (
    "kind", "assert_id", "cycle", "signals", "expected", "actual", "count", "baud_shadow",
    "write_fire", "ready",
)


def _has_any(text: Column, tokens) -> Column:
    """One alternation over short ids: small generated code, one pass."""
    return text.rlike("|".join(tokens))


def _pick(position: Column, values) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def _first(tests: list[Column]) -> Column:
    """Position of the first true test, else null."""
    chain = F.when(tests[0], 0)
    for position, test in enumerate(tests[1:], start=1):
        chain = chain.when(test, position)
    return chain


def _with_fields(df: DataFrame) -> DataFrame:
    """Structured part: ``_a`` is the position of the deciding rule, else null."""
    df = df.withColumn("_line", LF.structured_body(F.col("_log")))
    df = df.withColumns({f"_raw_{k}": LF.structured_raw(F.col("_line"), k) for k in _FIELDS})
    df = df.withColumns({f"_{k}": LF.raw_value(F.col(f"_raw_{k}")) for k in _FIELDS})
    df = df.withColumns(
        {"_kind": F.upper(F.col("_kind")), "_lower": F.lower(F.col("_assert_id"))}
    )
    failed = F.contains(F.col("_kind"), F.lit("ASSERT_FAIL"))
    by_id = _first([_has_any(F.col("_lower"), r.tokens) for r in STRUCTURED_IDS]) + F.lit(1)
    board = F.contains(F.col("_kind"), F.lit("SCOREBOARD_FAIL"))
    return once(df, "_a", F.when(board, 0).when(failed, by_id))


def _explained(label: Column, seen_in: Column, values: dict[str, Column]) -> Column:
    cause = F.element_at(F.create_map(*[F.lit(x) for pair in CAUSES.items() for x in pair]), label)
    details = [pair_text(k, values[k]) for k in DETAILS if k in values]
    return F.concat(cause, F.lit(". Seen in: "), F.concat_ws("; ", seen_in, *details), F.lit("."))


def _fields_verdict() -> Column:
    """Verdict for rows with ``_a``: 0 is the scoreboard, then STRUCTURED_IDS in order."""
    col = lambda k: F.col(f"_{k}")
    values = {k: col(k) for k in ("cycle", "expected", "actual", "write_fire", "ready", "signals")}
    values |= {
        "assertion_id": col("assert_id"),
        "count": F.when(col("count") != "", col("count")).otherwise(col("baud_shadow")),
    }
    label = _pick(col("a"), [L.DATA_INTEGRITY] + [r.label for r in STRUCTURED_IDS])
    return F.struct(
        label.alias("label"), _explained(label, F.lit(FROM_FIELDS), values).alias("explanation"),
        _pick(col("a"), [0.92] + [r.confidence for r in STRUCTURED_IDS]).alias("confidence"),
    )


# Free-text outcomes in test order: (label, confidence).
_TEXT_OUTCOMES = [
    (L.OFF_BY_ONE, 0.90), (L.HANDSHAKE, 0.85), (L.DATA_INTEGRITY, 0.88),
    (L.DATA_INTEGRITY, 0.78), (L.PARITY, 0.83), (L.ENABLE, 0.80),
    *[(r.label, r.confidence) for r in FALLBACK_IDS],
    (L.UNKNOWN, L.UNKNOWN_CONFIDENCE),
]


def _with_text(df: DataFrame) -> DataFrame:
    """Free-text part, only for rows without ``_a``: ``_b`` is the outcome's position."""
    open_row = F.col("_a").isNull()
    log = F.col("_log")
    df = df.withColumns(
        {
            "_folded": F.when(open_row, fold_case(log)).otherwise(""),
            "_id": F.when(open_row, LF.assertion_id(log)),
            "_seen": F.when(open_row, F.regexp_extract(log, _MISMATCH, 3)),
        }
    )
    df = df.withColumns(
        {
            "_lower": F.lower(F.col("_id")),
            "_when": F.when(open_row, LF.cycle_number(log)),
            "_dump": F.when(open_row, LF.signal_dump(log)),
        }
    )
    folded = F.col("_folded")
    tests = [
        any_match(folded, TEXT_COUNTER),
        any_match(folded, TEXT_HANDSHAKE),
        F.col("_seen") != "",
        any_match(folded, TEXT_DATA),
        any_match(folded, TEXT_PARITY),
        any_match(folded, TEXT_ENABLE),
        *[_has_any(F.col("_lower"), r.tokens) for r in FALLBACK_IDS],
    ]
    none = F.lit(len(_TEXT_OUTCOMES) - 1)
    return once(df, "_b", F.when(open_row, F.coalesce(_first(tests), none)))


def _with_values(df: DataFrame) -> DataFrame:
    """``_values``: what the wording itself names, for the outcomes that read values from it."""
    log, b = F.col("_log"), F.col("_b")
    counter = lambda k: F.regexp_extract(log, _COUNTER_LINEAR, k)
    found = F.struct(
        F.when(b == 0, counter(1)).alias("count"),
        F.when(b == 2, F.regexp_extract(log, _MISMATCH, 1)).alias("expected"),
        F.when(b == 2, F.regexp_extract(log, _MISMATCH, 2)).alias("actual"),
        F.when(b == 0, LF.absent_if_empty(counter(2))).when(b == 1, LF.at_cycle(log)).when(b == 2, F.col("_seen"))
        .alias("cycle"),
    )
    return df.withColumn("_values", found)


def _text_verdict() -> Column:
    b, found = F.col("_b"), F.col("_values")
    last = len(_TEXT_OUTCOMES) - 1
    seen_in = F.when(b < 6, FROM_TEXT).when(b < last, FROM_ID).otherwise(FROM_NOTHING)
    values = {
        "assertion_id": F.col("_id"), "cycle": F.coalesce(found["cycle"], F.col("_when")),
        "count": found["count"], "expected": found["expected"], "actual": found["actual"],
        "signals": F.col("_dump"),
    }
    label = _pick(b, [o[0] for o in _TEXT_OUTCOMES])
    return F.struct(
        label.alias("label"), _explained(label, seen_in, values).alias("explanation"),
        _pick(b, [o[1] for o in _TEXT_OUTCOMES]).alias("confidence"),
    )


def with_parsed_label(df: DataFrame, log: str = "log", out: str = "parsed") -> DataFrame:
    """Add the parser's verdict struct for the text column ``log``.

    Each stage is a projection that later ones use more than once, so the
    optimizer keeps them apart and every generated method stays small enough
    for the JVM to compile.
    """
    staged = _with_fields(df.withColumn("_log", F.coalesce(F.col(log), F.lit(""))))
    staged = staged.withColumn("_by_field", F.when(F.col("_a").isNotNull(), _fields_verdict()))
    staged = _with_values(_with_text(staged))
    known = F.col("_by_field")
    verdict = F.when(known.isNotNull(), known).otherwise(_text_verdict())
    return staged.withColumn(out, verdict).select(*df.columns, out)
