"""Fields read out of a log text: ids, cycles, signal dumps, structured lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.formats import STRUCTURED_PREFIX
from .textforms import absent_if_empty, let, strip

# --- fixed values: field patterns ------------------------------------------
SIGNAL_NAMES = (
    "count", "wptr", "rptr", "full", "empty", "ready", "valid", "wr_en", "rd_en",
    "write_fire", "expected", "actual", "baud_shadow", "bit_cnt", "shift_reg", "tx",
    "cs_n", "sclk", "mosi", "irq", "parity_err",
)
ASSERT_ID = r"(?:ASSERT_ID|assert_id|id)\s*[:=]\s*([A-Za-z0-9_]+)"
SIGNAL_DUMP = r"(?:signal_dump|signals?)\s*[:=]\s*([^\n]+)"
SIGNAL_PAIR = r"\b(?:" + "|".join(SIGNAL_NAMES) + r")\s*=\s*[0-9A-Za-z_x]+"
# Possessive, so that long white space is scanned once.
CYCLE = r"cycle\s*+(?:[=:]\s*+)?(\d+)"
AT_CYCLE = r"at cycle (\d+)"
NOISE = (
    r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b",
    r"/tmp/[\w/]+",
    r"seed\s*=\s*\d+",
    r"Simulation time: \d+ ns",
)
# str.splitlines() ends lines at these too, beside those Java's ^ and . know.
EXTRA_LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e"
STRUCTURED_LINE = r"(?m)^TB_LOG\|(.*?=.*)"

_U = "(?dU)"


def _extract(log: Column, literals: tuple[str, ...], pattern: str) -> Column:
    """First group of a pattern that needs one of the literals; '' if there is no match."""
    needed = F.contains(log, F.lit(literals[0]))
    for literal in literals[1:]:
        needed = needed | F.contains(log, F.lit(literal))
    return F.when(needed, F.regexp_extract(log, _U + pattern, 1)).otherwise("")


def assertion_id(log: Column) -> Column:
    return absent_if_empty(_extract(log, ("=", ":"), ASSERT_ID))


def cycle_number(log: Column) -> Column:
    return absent_if_empty(_extract(log, ("cycle",), CYCLE))


def at_cycle(log: Column) -> Column:
    return absent_if_empty(_extract(log, ("at cycle ",), AT_CYCLE))


def signal_dump(log: Column) -> Column:
    """Rest of a signal line, else the known ``name=value`` pairs, else null."""
    rest = _extract(log, ("signal",), SIGNAL_DUMP)
    pairs = F.array_join(F.regexp_extract_all(log, F.lit(_U + SIGNAL_PAIR), F.lit(0)), ", ")
    tidy = F.regexp_replace(pairs, _U + r"\s*+=\s*+", "=")
    # '' always means no match here: the pattern's group holds at least one character.
    return F.when(rest != "", strip(rest)).when(
        F.contains(log, F.lit("=")), absent_if_empty(tidy)
    )


def structured_body(log: Column) -> Column:
    """Body of the first structured line that holds at least one ``=``; '' if none."""
    odd = log.rlike(f"[{EXTRA_LINE_ENDS}]")
    lines = F.when(odd, F.translate(log, EXTRA_LINE_ENDS, "\n" * len(EXTRA_LINE_ENDS))).otherwise(log)
    return F.when(
        F.contains(log, F.lit(STRUCTURED_PREFIX)), F.regexp_extract(lines, STRUCTURED_LINE, 1)
    ).otherwise("")


def structured_raw(body: Column, key: str) -> Column:
    """``=value`` of ``key`` (last duplicate wins); '' if the key is absent."""
    return F.regexp_extract(body, rf"(?sU)^(?:.*\|)?\s*{key}\s*(=[^|]*)", 1)


def raw_value(raw: Column) -> Column:
    return strip(F.substr(raw, F.lit(2)))


def structured_fields(log: Column) -> Column:
    """``map<string,string>`` of the structured line; empty when there is none."""
    body = structured_body(log)
    parts = F.filter(F.split(body, r"\|", -1), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("key"),
            strip(F.substr(p, F.locate("=", p) + F.lit(1))).alias("value"),
        ),
    )

    def keep_last(bound: Column) -> Column:
        backwards = bound["backwards"]
        keys = F.transform(backwards, lambda e: e["key"])
        return let(
            {"b": backwards, "k": keys},
            lambda v: F.map_from_entries(
                F.reverse(
                    F.filter(v["b"], lambda e, i: F.array_position(v["k"], e["key"]) == i + F.lit(1))
                )
            ),
        )

    built = let({"backwards": F.reverse(pairs)}, keep_last)
    return F.when(body != "", built).otherwise(F.create_map().cast("map<string,string>"))


def normalise_noise(log: Column) -> Column:
    """Remove run-dependent text, then collapse white space."""
    out = log
    for pattern in NOISE:
        out = F.regexp_replace(out, _U + pattern, "")
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def behaviour_hash(log: Column) -> Column:
    return F.sha2(normalise_noise(log), 256)
