"""Reproducible draws: numbers cut out of an md5 over (seed, row key, slot).

The same row gets the same numbers on every run, in any order and partitioning.
One digest gives two 60-bit integers: the first holds cycle, count, expected and
actual in mixed radix, the second addr, data and a choice among options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.templates import FILL_RANGES

_HEX = 15  # digits per integer
_FIRST = ("cycle", "count", "expected", "actual")
_SECOND = ("addr", "data")
_HEX_WIDTH = {"addr": 4, "data": 2}


def digest(seed: int, key: Column, slot: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(slot)).cast("binary"))


def with_draws(rows: DataFrame, seed: int, key: Column, slots: dict[str, Column | None]) -> DataFrame:
    """Add ``_<slot>_a`` and ``_<slot>_b`` per slot; null where its condition is false.

    Digests and integers are projections of their own, so every text that is
    built from them reads finished numbers.
    """
    digests = {}
    for slot, condition in slots.items():
        drawn = digest(seed, key, slot)
        digests[f"_{slot}_d"] = drawn if condition is None else F.when(condition, drawn)
    whole = lambda d, start: F.conv(F.substring(d, start, _HEX), 16, 10).cast("bigint")
    numbers = {}
    for slot in slots:
        numbers[f"_{slot}_a"] = whole(F.col(f"_{slot}_d"), 1)
        numbers[f"_{slot}_b"] = whole(F.col(f"_{slot}_d"), 1 + _HEX)
    return rows.withColumns(digests).withColumns(numbers).drop(*digests)


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def _mixed_radix(number: Column, names: tuple[str, ...]) -> list[Column]:
    out = []
    for name in names:
        low, span = FILL_RANGES[name]
        out.append(number % F.lit(span) + F.lit(low))
        number = _div(number, span)
    return out


def choice(slot: str, span: int | Column) -> Column:
    """Integer in ``[0, span)`` of a slot, independent of its fill numbers."""
    rest = _div(F.col(f"_{slot}_b"), FILL_RANGES["addr"][1] * FILL_RANGES["data"][1])
    return (rest % (F.lit(span) if isinstance(span, int) else span)).cast("int")


def choose(options, slot: str) -> Column:
    """One of a fixed list of texts, uniformly."""
    return F.get(F.array(*[F.lit(o) for o in options]), choice(slot, len(options)))


def marks_in(options) -> tuple[str, ...]:
    """Fill numbers that some of the templates ask for.

    Only plain marks count: ``{addr:04x}`` and the like stay as written.
    """
    return tuple(n for n in FILL_RANGES if any("{" + n + "}" in o for o in options))


def fill(template: Column, slot: str, names: tuple[str, ...] = tuple(FILL_RANGES)) -> Column:
    """Put the slot's numbers into a template that uses no other marks than ``names``."""
    numbers = dict(zip(_FIRST, _mixed_radix(F.col(f"_{slot}_a"), _FIRST), strict=True))
    numbers |= zip(_SECOND, _mixed_radix(F.col(f"_{slot}_b"), _SECOND), strict=True)
    out = template
    for name in names:
        text = numbers[name].cast("string")
        if name in _HEX_WIDTH:
            text = F.lpad(F.lower(F.hex(numbers[name])), _HEX_WIDTH[name], "0")
        out = F.replace(out, F.lit("{" + name + "}"), text)
    return out
