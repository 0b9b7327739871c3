"""Masking of comments and string literals, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.formats import PLACEHOLDER_CLOSE, PLACEHOLDER_OPEN
from ..catalog.mutations import MASKED, PLACEHOLDER
from .textforms import let


def masked_literals(source: Column) -> Column:
    """Comments and string literals in order; index = placeholder number."""
    return F.regexp_extract_all(source, F.lit(MASKED), F.lit(0))


def masked_text(source: Column) -> Column:
    """Source with the i-th comment or literal replaced by placeholder i."""
    return F.array_join(
        F.transform(
            F.split(source, MASKED, -1),
            lambda gap, i: F.when(i == 0, gap).otherwise(
                F.concat(
                    F.lit(PLACEHOLDER_OPEN), (i - F.lit(1)).cast("string"),
                    F.lit(PLACEHOLDER_CLOSE), gap,
                )
            ),
        ),
        "",
    )


def restore(masked: Column, literals: Column) -> Column:
    """Put the literals back; placeholders without a literal stay as they are."""
    bound = {
        "literals": literals,
        "gaps": F.split(masked, PLACEHOLDER, -1),
        "marks": F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(0)),
    }

    def join(b: Column) -> Column:
        def piece(gap: Column, mark: Column) -> Column:
            index = F.regexp_extract(mark, PLACEHOLDER, 1).try_cast("int")
            return F.concat(F.coalesce(F.get(b["literals"], index), mark, F.lit("")), gap)

        leading = F.array(F.lit(None).cast("string"))
        return F.array_join(F.zip_with(b["gaps"], F.concat(leading, b["marks"]), piece), "")

    return let(bound, join)
