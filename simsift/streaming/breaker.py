"""Circuit breaker over tables and streams of service calls.

Calls have ``service``, ``call_id``, ``ts_us`` (microseconds) and ``ok``; their
order per service is (ts_us, call_id).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..catalog.formats import STATE_CLOSED, STATE_HALF_OPEN, STATE_OPEN
from ..catalog.labels import BREAKER_FAILURE_THRESHOLD, BREAKER_RECOVERY_SECONDS
from ..session import shared_dir, stored
from . import scan
from .fold import Breaker, fold_calls

_ORDER = ["service", "ts_us", "call_id"]
_NAMES = np.array([STATE_CLOSED, STATE_OPEN, STATE_HALF_OPEN], dtype=object)
_RESULT = "call_id bigint, ts_us bigint, ok boolean, admitted boolean, state string, failure_count bigint"


def _runs(services: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal neighbours."""
    cuts = np.flatnonzero(services[1:] != services[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(services)]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def _edge_summaries(threshold: int, recovery_us: int):
    """Summaries of the services that a chunk begins and ends with; others lie within the chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, service, calls, first = None, None, [], True

        def summary() -> pd.DataFrame:
            ts, ok = (np.concatenate(x) for x in zip(*calls, strict=True))
            rows = scan.to_rows(chunk, scan.summarise(ts, ok, threshold, recovery_us))
            return rows.assign(service=service, first=first)

        for pdf in batches:
            if pdf.empty:
                continue
            names, ts, ok = pdf["service"].to_numpy(), pdf["ts_us"].to_numpy(), pdf["ok"].to_numpy().astype(bool)
            chunk = int(pdf["chunk"].iloc[0])
            for a, b in _runs(names):
                if calls and names[a] != service:
                    if first:
                        yield summary()
                    calls, first = [], False
                service = names[a]
                calls.append((ts[a:b], ok[a:b]))
        if calls:
            yield summary()

    return run


def _chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One summary of the neighbouring stretches of a service."""
    parts = [scan.from_rows(rows[rows["chunk"] == c]) for c in sorted(rows["chunk"].unique())]
    return scan.to_rows(key[1], functools.reduce(scan.chained, parts)).assign(service=key[0])


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The breaker that each stretch of a group begins with, from the one that the group begins with."""
    state, out = Breaker(*map(int, rows[["at_mode", "at_failures", "at_last"]].iloc[0])), []
    for c in sorted(rows["chunk"].unique()):
        out.append((c, *state))
        state = scan.after(state, scan.from_rows(rows[rows["chunk"] == c]))
    made = pd.DataFrame(out, columns=["chunk", "at_mode", "at_failures", "at_last"])
    return made.assign(service=key[0])


def _entries(edges: DataFrame, kind: str, fan: int) -> DataFrame:
    """(service, chunk, at_mode, at_failures, at_last): the breaker before every stretch.

    A prefix scan in levels of ``fan``: summaries of neighbours are chained upwards until one group is left, then the
    states are handed down. The number of jobs follows from the number of chunks alone.
    """
    group = F.floor(F.col("chunk") / fan).alias("group")
    levels = [edges.drop("first")]
    n = (edges.agg(F.max("chunk")).first()[0] or 0) // fan
    while n:
        up = levels[-1].groupBy("service", group).applyInPandas(_chain, f"service {kind}, {scan.TYPES}")
        levels.append(stored(up, "summaries"))
        n //= fan
    before = None
    for level in reversed(levels):
        rows = level.withColumn("group", group)
        if before is None:
            fresh = zip(("at_mode", "at_failures", "at_last"), Breaker(), strict=True)
            rows = rows.withColumns({name: F.lit(value) for name, value in fresh})
        else:
            rows = rows.join(before.withColumnRenamed("chunk", "group"), ["service", "group"])
        walked = rows.groupBy("service", "group").applyInPandas(
            _walk, f"service {kind}, chunk bigint, at_mode bigint, at_failures bigint, at_last bigint"
        )
        before = stored(walked, "entries")
    return before


def _emit(threshold: int, recovery_us: int):
    """Outcomes of a chunk's calls; its first service goes on from the breaker it is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, carry = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            names = pdf["service"].to_numpy()
            ts, ok = pdf["ts_us"].to_numpy(), pdf["ok"].to_numpy().astype(bool)
            admitted = np.empty(len(pdf), dtype=bool)
            modes = np.empty(len(pdf), dtype=np.int8)
            counts = np.empty(len(pdf), dtype=np.int64)
            for a, b in _runs(names):
                if carry is None:
                    carry = Breaker(*(int(pdf[c].iloc[0]) for c in ("at_mode", "at_failures", "at_last")))
                elif names[a] != service:
                    carry = Breaker()
                service = names[a]
                admitted[a:b], modes[a:b], counts[a:b], carry = fold_calls(
                    ts[a:b], ok[a:b], carry, threshold, recovery_us
                )
            yield _outcome(pdf, admitted, modes, counts)

    return run


def replay_breaker(
    calls: DataFrame,
    threshold: int = BREAKER_FAILURE_THRESHOLD,
    recovery_s: float = BREAKER_RECOVERY_SECONDS,
    chunks: int | None = None,
    fan: int = 64,
) -> DataFrame:
    """Outcome of every call of a table: admitted, state and failure_count after it.

    A service may hold a third of all calls, so calls are range-partitioned by
    (service, time, id): big services span many chunks. Each chunk is read once to sum up what
    it does to any breaker, the summaries are chained in a prefix scan, and each chunk
    is folded once, from the breaker it really begins with. The result is exactly the sequential fold.
    The chunks are checkpointed, so both passes and every retry read the same.

    Needed in memory: a chunk's times of one service, and ``fan`` summaries of at most two rows per
    failure within the recovery time after the chunk's first call. A null ``ok`` is a failure. An empty table gives
    an empty result.
    """
    spark = calls.sparkSession
    shared_dir(spark)
    recovery_us = int(round(recovery_s * 1_000_000))
    # Without a number AQE merges small neighbouring ranges into chunks of a good size.
    ranges = [chunks, *_ORDER] if chunks else _ORDER
    ordered = (
        calls.select("service", "ts_us", "call_id", F.coalesce("ok", F.lit(False)).alias("ok"))
        .repartitionByRange(*ranges)
        .sortWithinPartitions(*_ORDER)
        .withColumn("chunk", F.spark_partition_id())
        .checkpoint()
    )
    kind = ordered.schema["service"].dataType.simpleString()
    edges = stored(
        ordered.mapInPandas(_edge_summaries(threshold, recovery_us), f"service {kind}, first boolean, {scan.TYPES}"), "edges"
    )
    firsts = edges.filter("first").select("service", "chunk").distinct()
    entries = _entries(edges, kind, fan).join(firsts, ["service", "chunk"]).drop("service")
    # one row per chunk, as Spark's driver keeps itself
    begun = ordered.join(F.broadcast(entries), "chunk")
    return begun.mapInPandas(_emit(threshold, recovery_us), f"service {kind}, {_RESULT}")


def _outcome(pdf: pd.DataFrame, admitted, modes, counts) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "service": pdf["service"].to_numpy(),
            "call_id": pdf["call_id"].to_numpy(),
            "ts_us": pdf["ts_us"].to_numpy(),
            "ok": pdf["ok"].to_numpy(),
            "admitted": admitted,
            "state": _NAMES[modes],
            "failure_count": counts,
        }
    )


class _OrderedCalls(StatefulProcessor):
    """A service's calls on a stream: kept by time slot until the watermark has passed the slot, then folded.

    State: the breaker, and per open slot the calls of each frame that brought some. What is
    held at once is one arriving frame, or the calls of one slot.
    """

    def __init__(self, threshold: int, recovery_us: int, slot_us: int):
        self.threshold, self.recovery_us, self.slot_us = threshold, recovery_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "mode int, failures bigint, last_failure bigint")
        self.sizes = handle.getMapState("sizes", "slot bigint", "parts int")
        self.parts = handle.getMapState(
            "parts", "slot bigint, part int", "ts array<bigint>, ids array<bigint>, ok array<boolean>"
        )

    def _due(self, slot: int) -> int:
        """Milliseconds at which no call of the slot can come any more."""
        return -(-(slot + 1) * self.slot_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for slot, part in pdf.groupby(pdf["ts_us"] // self.slot_us):
                slot = int(slot)
                if self._due(slot) <= passed:
                    continue  # later than the watermark allows
                n = self.sizes.getValue((slot,))[0] if self.sizes.containsKey((slot,)) else 0
                if n == 0:
                    self.handle.registerTimer(self._due(slot))
                ok = part["ok"].fillna(False).astype(bool)
                self.parts.updateValue((slot, n), (part["ts_us"].tolist(), part["call_id"].tolist(), ok.tolist()))
                self.sizes.updateValue((slot,), (n + 1,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slot_us - 1
        frames = []
        for part in range(self.sizes.getValue((slot,))[0]):
            frames.append(pd.DataFrame(dict(zip(("ts_us", "call_id", "ok"), self.parts.getValue((slot, part))))))
            self.parts.removeKey((slot, part))
        self.sizes.removeKey((slot,))
        pdf = pd.concat(frames).sort_values(["ts_us", "call_id"], kind="stable").assign(service=key[0])
        breaker = Breaker(*self.breaker.get()) if self.breaker.exists() else Breaker()
        *out, end = fold_calls(
            pdf["ts_us"].to_numpy(), pdf["ok"].to_numpy().astype(bool), breaker, self.threshold, self.recovery_us
        )
        self.breaker.update(tuple(map(int, end)))
        yield _outcome(pdf, *out)


def stream_breaker(
    calls: DataFrame,
    threshold: int = BREAKER_FAILURE_THRESHOLD,
    recovery_s: float = BREAKER_RECOVERY_SECONDS,
    delay: str = "10 minutes",
    slot_s: float = 60.0,
) -> DataFrame:
    """The same fold on a stream: calls count in (time, id) order, however they arrive.

    A call may come later than others by ``delay``; then its outcome is that of the table's replay. Calls that come
    later still are dropped, as Spark's watermark has it. Outcomes of a slot of ``slot_s`` seconds (whole milliseconds)
    follow when the watermark has passed its end, slot by slot.

    Needs Spark's RocksDB state store, which is set for the session's queries from here on.
    """
    spark = calls.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    recovery_us, slot_us = int(round(recovery_s * 1_000_000)), 1000 * int(round(slot_s * 1000))
    kind = calls.schema["service"].dataType.simpleString()
    timed = calls.select("service", "call_id", "ts_us", "ok", F.timestamp_micros("ts_us").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("service").transformWithStateInPandas(
        _OrderedCalls(threshold, recovery_us, slot_us), f"service {kind}, {_RESULT}", "Append", "EventTime"
    )


def health(outcomes: DataFrame) -> DataFrame:
    """Latest state and failure count per service (combined map-side)."""
    latest = F.max_by(F.struct("state", "failure_count"), F.struct("ts_us", "call_id"))
    return outcomes.groupBy("service").agg(latest.alias("_h")).select(
        "service", F.col("_h.state").alias("circuit_state"),
        F.col("_h.failure_count").alias("circuit_failures"),
    )


def route(outcomes: DataFrame, fallback: bool = True) -> DataFrame:
    """Add ``route`` (model, rules, error) and ``status`` (200, 502, 503)."""
    rejected, failed = ~F.col("admitted"), ~F.col("ok")
    if fallback:
        where = F.when(rejected | failed, "rules").otherwise("model")
        return outcomes.withColumns({"route": where, "status": F.lit(200)})
    where = F.when(rejected | failed, "error").otherwise("model")
    status = F.when(rejected, 503).when(failed, 502).otherwise(200)
    return outcomes.withColumns({"route": where, "status": status})
