"""Headline queries on the tables at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import time

from simsift.plans.queries import QUERIES
from simsift.session import local_session, scratch_path

HEADLINE = (
    "cls1_rule_verdicts",
    "cls2_parsed_labels",
    "cls3_model_or_rules",
    "cls4_full_triage",
    "agg2_confusion",
    "agg9_ab_report",
    "agg8_p95",
    "txt6_behaviour_hash",
    "jn2_inert_runs",
    "mut10_all_mutants",
    "gen6_augmented_corpus",
    "gen7_generated_corpus",
    "win1_shuffle_ranks",
    "win2_stratified_split",
    "str2_breaker_replay",
    "str1_continuous_triage",
)


def spread(spark, sf_dir: str, files: int) -> str:
    """The tables in several files each, as a cluster's tables are; a file of one row group is one task."""
    folder = scratch_path(spark, "bench")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(files).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    """Cold: the first run of each query; warm: the second one in the same session. Inputs are spread before."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    inputs = spread(spark, sf_dir, max(8, int(cores) if cores.isdigit() else 8))
    events = spark.read.parquet(f"{inputs}/events.parquet").count()
    cold = {name: timed(spark, name, inputs) for name in HEADLINE}
    warm = {name: timed(spark, name, inputs) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock of first runs",
                "value": round(sum(cold.values()), 3),
                "unit": "sec",
                "queries": cold,
                "warm_value": round(sum(warm.values()), 3),
                "warm": warm,
                "event_rows_per_s_warm": {name: round(events / s) for name, s in warm.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
