"""Linear-time, line-bound pattern tests on folded text.

A plain alternative such as ``a.*b.*c`` backtracks: on one long line its cost
grows with the third power of the length. Here each alternative becomes

* a bare ``contains`` when it is one literal,
* otherwise ``contains`` guards for its literal parts, and only if all are
  present the regex ``^(?>.*?a)(?>.*?b).*?c``. Atomic groups take the earliest
  occurrence of each segment and never come back, which is exact as long as
  the earliest occurrence of a segment is also the one that ends earliest
  (true for all literals).

Texts are folded once (``fold_case``) so that patterns run case-sensitively on
lower-case text, which is cheaper than case-insensitive matching.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# d: only \n ends a line; m: ^ at line starts; U: \s \d \w are Unicode classes.
_FLAGS = "(?dmU)"
_LITERAL = re.compile(r"[\w\- >=]+")
_SAME_LINE_SPACE = r"[^\S\n]*+"

# Two alternatives have a segment with inner whitespace (which may hold line
# breaks) in front of another segment, so "earliest" is not enough: one test
# for the case that all lies on one line, one for a segment that spills over.
_SPILL = r"(?=[^\S\n]*+(?:=[^\S\n]*+)?\n)\s*+=\s*+"
_WORD_WITH_COUNT = r"(?<!\w)(?>\w*?count)\w*+"
_SPECIAL = {
    r"valid\s*=\s*1.*ready\s*=\s*0": (
        rf"^(?>.*?valid{_SAME_LINE_SPACE}={_SAME_LINE_SPACE}1).*?ready\s*+=\s*+0"
        rf"|valid{_SPILL}1.*?ready\s*+=\s*+0"
    ),
    r"count\w*\s*=\s*\d+.*max": (
        rf"^(?>.*?{_WORD_WITH_COUNT}{_SAME_LINE_SPACE}={_SAME_LINE_SPACE}\d).*?max"
        rf"|{_WORD_WITH_COUNT}{_SPILL}\d.*?max"
    ),
}


def fold_case(text: Column) -> Column:
    """Lower-case text; letters whose case partner is ASCII are folded to it."""
    plain = F.lower(text)
    odd = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.lower(F.translate(text, "ſıİ", "siI"))).otherwise(plain)


def linear_regex(alternative: str) -> str:
    """Java regex with the same matches as the plain alternative, in linear time."""
    low = alternative.lower()
    if low in _SPECIAL:
        return _FLAGS + _SPECIAL[low]
    *first, last = low.split(".*")
    if not first:
        return _FLAGS + last
    return _FLAGS + "^" + "".join(f"(?>.*?{s})" for s in first) + f".*?{last}"


def guards(alternative: str) -> list[str]:
    """Literals that must all be present for the alternative to match."""
    found = [m.group(0) for s in alternative.lower().split(".*") if (m := _LITERAL.match(s))]
    return list(dict.fromkeys(found))


def is_literal(alternative: str) -> bool:
    return _LITERAL.fullmatch(alternative) is not None


def matches(folded: Column, alternative: str, known: dict[str, Column] | None = None) -> Column:
    """Does one alternative occur in the folded text?

    ``known`` holds columns that say whether a word occurs at all.
    """
    needed = guards(alternative)
    tests = [has for word, has in (known or {}).items() if any(word in g for g in needed)]
    tests += [F.contains(folded, F.lit(g)) for g in needed if g not in (known or {})]
    if not is_literal(alternative):
        tests.append(folded.rlike(linear_regex(alternative)))
    return reduce(lambda a, b: a & b, tests)


def any_match(folded: Column, alternatives, known: dict[str, Column] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [matches(folded, a, known) for a in alternatives])
