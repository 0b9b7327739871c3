"""Continuous triage: the batch operator on streams of requests and of call outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog.labels import CONFIDENCE_THRESHOLD
from ..operators.triage import answered, judged, triage


def request_stream(
    spark: SparkSession, path: str, schema: str = "id string, log string",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Stream of JSON-lines requests arriving as files in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def start_triage(requests: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run triage on arriving requests into parquet; errors keep their status."""
    return (
        triage(requests)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


#: State of joined streams in one store per partition, on disk, of which the executor holds a bounded share in memory;
#: Spark's own choice has four stores per partition with all rows on the executor's heap.
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Stream-stream joins that start inside the block for the first time keep their state on disk."""
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    try:
        for name, value in _ON_DISK.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def routed_triage(
    requests: DataFrame,
    outcomes: DataFrame,
    delay: str,
    wait: str,
    generated: DataFrame | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
    key: str = "id",
) -> DataFrame:
    """Answers to a stream of requests (key, at, log) with a stream of their calls' outcomes (key, at, route, status).

    A request takes the outcome of its call, if that lies within ``wait`` of it. One without a call is answered by
    the rules as soon as the watermarks, ``delay`` behind each stream's latest time, say that no outcome
    can come any more. The rules judge a request when it arrives, so the join's state
    holds verdicts and no logs. ``generated`` (key, generated_text) is a table, which every batch joins anew as a whole,
    or the text comes with the outcomes or the requests.
    """
    kept = F.col("at").alias("_at"), F.col(key).alias("_key"), *(F.col(c) for c in ("route", "status", "generated_text") if c in outcomes.columns)
    timed = requests.withWatermark("at", delay)
    called = outcomes.withWatermark("at", delay).select(*kept)
    near = F.expr(f"_key = {key} AND _at >= at - INTERVAL {wait} AND _at <= at + INTERVAL {wait}")
    carried = ("at", *(c for c in ("generated_text",) if c in requests.columns))
    rows = judged(timed, key, keep=carried).join(called, near, "left").drop("_key", "_at")
    if generated is not None:
        rows = rows.join(generated.select(key, "generated_text"), key, "left")
    return answered(rows, threshold, key)
