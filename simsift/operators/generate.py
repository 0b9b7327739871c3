"""Labelled corpus: every source with every mutation, its log and its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logfields import behaviour_hash
from ..functions.logparser import with_parsed_label
from .lookups import with_synthetic_log
from .mutate import MutationRegistry, spec_rows

CORPUS_COLUMNS = [
    "log", "label", "explanation", "confidence", "label_source", "module", "mutation_id", "tier",
    "is_inert",
]


def pair_up(sources: DataFrame, registry: MutationRegistry | None = None) -> DataFrame:
    """Every source row with every mutation spec: explode of a literal array, no shuffle."""
    return sources.withColumn("_s", F.explode(spec_rows(registry))).select(
        *sources.columns, "_s.mutation_id", "_s.label", "_s.tier", "_s.description"
    )


def golden_hashes(golden_runs: DataFrame) -> DataFrame:
    """(module, golden_hash) of reference runs that succeeded; ``module`` is unique."""
    return golden_runs.filter(F.coalesce("ok", F.lit(False))).select(
        "module", behaviour_hash(F.col("log")).alias("golden_hash")
    )


def with_inertness(runs: DataFrame, golden_runs: DataFrame) -> DataFrame:
    """Add ``is_inert``: the run succeeded and behaves like its module's golden run.

    The right side is narrow and has one row per module. A hot module on the
    left is left to AQE: it broadcasts by measured size or splits the skew.
    """
    own = F.when(F.coalesce("ok", F.lit(False)), behaviour_hash(F.col("log")))
    joined = runs.withColumn("_hash", own).join(golden_hashes(golden_runs), "module", "left")
    return joined.withColumn(
        "is_inert", F.coalesce(F.col("_hash") == F.col("golden_hash"), F.lit(False))
    ).drop("_hash", "golden_hash")


def drop_inert(rows: DataFrame, include_inert: bool = False) -> DataFrame:
    return rows if include_inert else rows.filter(~F.col("is_inert"))


def _corpus(rows: DataFrame) -> DataFrame:
    return rows.select(*CORPUS_COLUMNS)


def generate_corpus(
    sources: DataFrame,
    run_logs: DataFrame | None = None,
    golden_runs: DataFrame | None = None,
    include_inert: bool = False,
    registry: MutationRegistry | None = None,
) -> DataFrame:
    """Corpus rows for ``sources(module)``.

    With ``run_logs(module, mutation_id, log, ok)`` and
    ``golden_runs(module, log, ok)``, modules whose golden run succeeded are
    labelled by the log parser; all others by their mutation, with the kept log.
    """
    pairs = with_synthetic_log(pair_up(sources.select("module"), registry))
    by_mutation = {
        "explanation": F.col("description"),
        "confidence": F.lit(1.0),
        "label_source": F.lit("mutation"),
        "is_inert": F.lit(False),
    }
    if run_logs is None or golden_runs is None:
        return _corpus(pairs.withColumns(by_mutation))

    runs = run_logs.select("module", "mutation_id", F.col("log").alias("_run_log"), "ok")
    rows = pairs.join(golden_hashes(golden_runs), "module", "left").join(
        runs, ["module", "mutation_id"], "left"
    )
    simulated = F.col("golden_hash").isNotNull()
    own = F.when(F.coalesce("ok", F.lit(False)), behaviour_hash(F.col("_run_log")))
    rows = rows.withColumn("is_inert", F.coalesce(own == F.col("golden_hash"), F.lit(False)))
    # Only simulated logs reach the parser's patterns; other rows pass it an empty text.
    rows = drop_inert(rows, include_inert).withColumn("_text", F.when(simulated, F.col("_run_log")))
    parsed = with_parsed_label(rows, "_text")
    chosen = lambda seen, otherwise: F.when(simulated, seen).otherwise(otherwise)
    return _corpus(
        parsed.withColumns(
            {
                "log": chosen(F.coalesce("_run_log", F.lit("")), F.col("log")),
                "label": chosen(F.col("parsed.label"), F.col("label")),
                "explanation": chosen(F.col("parsed.explanation"), by_mutation["explanation"]),
                "confidence": chosen(F.col("parsed.confidence"), by_mutation["confidence"]),
                "label_source": chosen(F.lit("log_parser"), by_mutation["label_source"]),
            }
        )
    )
