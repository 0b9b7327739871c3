"""Fixed catalogues as small DataFrames, and the joins onto them.

The catalogues are constants of this package (45, 10 and 9 rows), so their
size is known and broadcasting them is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import templates as T


def constant_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """DataFrame of literal rows (no Python data source involved)."""
    structs = [
        F.struct(*[
            (F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)).alias(n)
            for n, v in zip(names, row, strict=True)
        ])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def synthetic_log_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, ["mutation_id", "module", "kept_log"], T.synthetic_logs())


def template_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, ["mutation_id", "module", "template"], T.log_templates())


def label_lines_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, ["label", "lines"], list(T.LABEL_LINES.items()))


def _fallback_log(mutation_id: Column, module: Column) -> Column:
    head, middle, tail = T.FALLBACK_LOG
    return F.concat(F.lit(head), mutation_id, F.lit(middle), module, F.lit(tail))


def with_synthetic_log(rows: DataFrame, out: str = "log") -> DataFrame:
    """Add the kept log of (mutation_id, module); generic text where none is kept."""
    joined = rows.join(
        F.broadcast(synthetic_log_table(rows.sparkSession)), ["mutation_id", "module"], "left"
    )
    text = F.coalesce(F.col("kept_log"), _fallback_log(F.col("mutation_id"), F.col("module")))
    return joined.withColumn(out, text).drop("kept_log")


def with_label_lines(rows: DataFrame) -> DataFrame:
    """Add ``lines``: the phrasings of the row's label; one fallback for other labels."""
    joined = rows.join(F.broadcast(label_lines_table(rows.sparkSession)), "label", "left")
    fallback = F.array(F.lit(T.OTHER_LABEL_LINE))
    return joined.withColumn("lines", F.coalesce(F.col("lines"), fallback))
