"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage but the last returns the columns of ``documents``. Between stages the table is
written as Parquet in the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simsift.llm import decontaminate, hostrules, jaccard, lines, packing
from simsift.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go."""
    # measured once: rows that pass go along, so the hosts' verdicts need no second pass over the texts
    measured = stored(hostrules.with_passing_rows(hostrules.measures(docs)), "measured")
    counts = stored(hostrules.host_counts(measured), "host_counts")
    verdicts = stored(hostrules.host_verdicts(counts), "hosts")
    return hostrules.with_verdict(measured, verdicts).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, documents stay; n_chars follows the text."""
    done = lines.without_repeats(docs)
    chars = F.when(F.col("lines.dropped") > 0, F.length("row.text")).otherwise(F.col("row.n_chars"))
    return done.select(F.col("row").withField("n_chars", chars.cast("bigint")).alias("row")).select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the least id stays."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens."""
    return packing.pack(docs, packing.public_packing())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot tokenise; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
