"""Labelled rewrites of source text: mask, rewrite, restore, all native columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import mutations as M
from ..catalog.mutations import MutationSpec
from ..functions.masking import masked_literals, masked_text, restore
from ..functions.textforms import let

Rewrite = Callable[[Column], Column]
_U = "(?dU)"


def _sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, _U + pattern, replacement)


def _nonblocking_to_blocking(t: Column) -> Column:
    return _sub(t, M.NONBLOCKING, "$1=")


def _posedge_to_negedge(t: Column) -> Column:
    return _sub(t, M.POSEDGE, "negedge")


def _reset_inversion(t: Column) -> Column:
    return _sub(t, M.RESET_TEST, "if (rst_n)")


def _enable_polarity_flip(t: Column) -> Column:
    return _sub(t, M.ENABLE_TEST, "if (!$1)")


def _one_less(digits: Column) -> Column:
    """A number written in digits, of any length, less one; 0 stays 0. No leading zeros come out."""
    head = F.regexp_replace(digits, "0+$", "")
    zeros = F.length(digits) - F.length(head)
    last = F.right(head, F.lit(1)).try_cast("int") - 1
    lowered = F.concat(F.left(head, F.length(head) - 1), last.cast("string"), F.repeat(F.lit("9"), zeros))
    return F.when(head == "", "0").otherwise(F.regexp_replace(lowered, "^0+(?=.)", ""))


def _lower_literal_bounds(t: Column) -> Column:
    """``{s[n:0], t}`` -> ``{s[max(0, n-1):0], t}``: arithmetic, so split and rebuild."""
    pattern = _U + M.SHIFT_IN_LITERAL
    group = lambda m, k: F.regexp_extract(m, pattern, k)

    def rebuilt(match: Column) -> Column:
        lowered = F.concat(F.lit("{"), group(match, 1), F.lit("["), _one_less(group(match, 2)), F.lit(":0], "),
                           group(match, 3), F.lit("}"))
        return F.coalesce(lowered, match)

    def join(b: Column) -> Column:
        heads = F.concat(F.array(F.lit("")), F.transform(b["found"], rebuilt))
        return F.array_join(F.zip_with(heads, b["gaps"], lambda head, gap: F.concat(head, gap)), "")

    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    rewritten = let({"found": found, "gaps": F.split(t, pattern, -1)}, join)
    return F.when(t.rlike(pattern), rewritten).otherwise(t)


def _data_width_truncation(t: Column) -> Column:
    widened = _sub(t, M.SHIFT_RIGHT, "{2'b00, $1[")
    return _sub(_lower_literal_bounds(widened), M.SHIFT_IN_PARAMETER, "{$1[$2-1:0], $3}")


def _counter_boundary(t: Column) -> Column:
    return _sub(t, M.COUNT_BOUND, "$1 <= $2")


def _handshake_violation(t: Column) -> Column:
    return _sub(t, M.READY_TERM, "")


def _overflow_guard_removal(t: Column) -> Column:
    return _sub(_sub(t, M.MINUS_ONE, "$1$2"), M.BIT_ABOVE_ZERO, "bit_cnt >= 0")


def _parity_check_removal(t: Column) -> Column:
    zeroed = _sub(t, M.PARITY_ASSIGN, "$11'b0;")
    return _sub(_sub(zeroed, M.PARITY_TEST, "if (1'b0)"), M.PARITY_OUT, "$1;")


class MutationRegistry:
    """Ordered catalogue of mutations; ids are unique."""

    def __init__(self) -> None:
        self._entries: dict[str, tuple[MutationSpec, Rewrite]] = {}

    def register(self, spec: MutationSpec, rewrite: Rewrite) -> MutationSpec:
        """Add a mutation: ``rewrite`` maps masked text to rewritten masked text."""
        if spec.mutation_id in self._entries:
            raise ValueError(f"Duplicate mutation id: {spec.mutation_id}")
        self._entries[spec.mutation_id] = (spec, rewrite)
        return spec

    def ids(self) -> list[str]:
        return list(self._entries)

    def specs(self) -> list[MutationSpec]:
        return [spec for spec, _ in self._entries.values()]

    def rewrite(self, mutation_id: str) -> Rewrite:
        return self._entries[mutation_id][1]


_REWRITES = (
    _nonblocking_to_blocking,
    _posedge_to_negedge,
    _reset_inversion,
    _enable_polarity_flip,
    _data_width_truncation,
    _counter_boundary,
    _handshake_violation,
    _overflow_guard_removal,
    _parity_check_removal,
)


def default_registry() -> MutationRegistry:
    registry = MutationRegistry()
    for spec, rewrite in zip(M.SPECS, _REWRITES, strict=True):
        registry.register(spec, rewrite)
    return registry


def with_masked(sources: DataFrame, text: str = "text") -> DataFrame:
    """Add ``masked`` and ``literals``: computed once, used by every mutation."""
    return sources.withColumns(
        {"masked": masked_text(F.col(text)), "literals": masked_literals(F.col(text))}
    )


def mutate(
    sources: DataFrame,
    registry: MutationRegistry | None = None,
    ids: Iterable[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """One row per (source, mutation): spec fields, mutated_source, changed.

    The text is masked once per source; the rewrites become one array that is
    exploded, so nothing is shuffled and no cross join is needed.
    """
    registry = registry or default_registry()
    wanted = list(ids) if ids is not None else registry.ids()
    specs = [s for s in registry.specs() if s.mutation_id in wanted]

    def outcome(spec: MutationSpec) -> Column:
        return F.struct(
            F.lit(spec.mutation_id).alias("mutation_id"),
            F.lit(spec.label).alias("label"),
            F.lit(spec.tier).alias("tier"),
            F.lit(spec.description).alias("description"),
            registry.rewrite(spec.mutation_id)(F.col("masked")).alias("rewritten"),
        )

    exploded = with_masked(sources, text).withColumn(
        "_m", F.explode(F.array(*[outcome(s) for s in specs]))
    )
    # A rewrite that left the masked text alone needs no restoring.
    mutated = F.when(F.col("_m.rewritten") == F.col("masked"), F.col(text)).otherwise(
        restore(F.col("_m.rewritten"), F.col("literals"))
    )
    return (
        exploded.withColumn("mutated_source", mutated)
        .withColumns(
            {name: F.col(f"_m.{name}") for name in ("mutation_id", "label", "tier", "description")}
        )
        .withColumn("changed", F.col("mutated_source") != F.col(text))
        .drop("_m", "masked", "literals")
    )


def spec_rows(registry: MutationRegistry | None = None) -> Column:
    """Array of spec structs as one literal column (nine short rows by default)."""
    registry = registry or default_registry()
    return F.array(
        *[
            F.struct(
                F.lit(s.mutation_id).alias("mutation_id"),
                F.lit(s.label).alias("label"),
                F.lit(s.tier).alias("tier"),
                F.lit(s.description).alias("description"),
            )
            for s in registry.specs()
        ]
    )
