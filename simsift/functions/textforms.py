"""Small text helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: characters Python's str.strip() takes as white space ----
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim white space at both ends (Unicode-aware)."""
    return F.btrim(text, F.lit(PY_SPACES))


def absent_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def let(bindings: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``bindings`` once and hand them to ``body`` as a struct.

    Higher-order functions re-evaluate captured expressions for every element;
    binding them first keeps such expressions linear.
    """
    packed = F.struct(*[c.alias(n) for n, c in bindings.items()])
    return F.transform(F.array(packed), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed exactly once per row.

    Filters on a projected column are pushed below the projection and computed
    a second time there. A one-element explode stays where it is: later filters
    and projections read its result.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, no grouping (half-even on the exact value)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def rounded(x: Column, digits: int) -> Column:
    return fixed(x, digits).cast("double")


def percent(x: Column) -> Column:
    return F.concat(fixed(x * F.lit(100.0), 1), F.lit("%"))


def pair_text(name: str, value: Column) -> Column:
    """``name=value``, or null when the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(name + "="), value))
