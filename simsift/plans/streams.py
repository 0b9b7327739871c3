"""Registered queries: continuous triage and the call breaker, on tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import formats as FM
from ..operators import triage as OT
from ..session import scratch_path, stored
from ..sources import writers as W
from ..streaming import breaker as B
from ..streaming.triage import request_stream, routed_triage, start_triage, state_on_disk
from . import derived as D
from . import oracle as S
from .classification import FULL_TRIAGE
from .registry import query

THRESHOLD, RECOVERY_S = 5, 6 * 3600
#: How feeds of logs are written: compressed, and in files small enough for a task each.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 20_000}

_g = S.gated(0.7)
_STREAMED = f"""WITH {S._SIM}, r AS (SELECT id::VARCHAR AS id, log FROM sim UNION ALL
  SELECT 'd' || id::VARCHAR, log FROM ({f'WITH {S._LONG} SELECT * FROM long'})),
c AS (SELECT id, length(log) > 100000 AS too_long, {S.cut('log')} AS log FROM r), {S.verdicts('c')}
SELECT id, CASE WHEN too_long THEN 400 ELSE 200 END AS status, CASE WHEN NOT too_long THEN {_g[0]} END AS label,
  CASE WHEN NOT too_long THEN {_g[1]} END AS explanation, CASE WHEN NOT too_long THEN {_g[2]} END AS confidence,
  CASE WHEN too_long THEN {S.q(FM.TOO_LONG_DETAIL)} END AS detail FROM cls"""


@query("str1_continuous_triage", "STR-1 SRC-6", _STREAMED)
def continuous_triage(spark, sf):
    """Requests land as JSON files; the stream runs until all are done."""
    feed, out, state = (scratch_path(spark, n) for n in ("feed", "answers", "state"))
    logs = D.sim_logs(spark, sf).select(F.col("id").cast("string").alias("id"), "log")
    longs = D.long_logs(spark, sf).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), "log")
    W.write_jsonl(logs.unionByName(longs), feed, **PACKED)
    done = start_triage(request_stream(spark, feed), out, state, availableNow=True)
    done.awaitTermination()
    return spark.read.parquet(out)


@query("src6_request_feed", "SRC-6", f"WITH {S._SIM} SELECT id::VARCHAR AS id, md5(log) AS log_md5 FROM sim")
def request_feed(spark, sf):
    feed, out, state = (scratch_path(spark, n) for n in ("feed", "read", "state"))
    W.write_jsonl(D.sim_logs(spark, sf).select(F.col("id").cast("string").alias("id"), "log"), feed)
    rows = request_stream(spark, feed).select("id", F.md5(F.col("log").cast("binary")).alias("log_md5"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out)


_BREAKER = f"WITH RECURSIVE {S.breaker(THRESHOLD, RECOVERY_S)}"


@query("str2_breaker_replay", "STR-2",
       f"{_BREAKER} SELECT service, call_id, ts_us, ok, admitted, state, cnt AS failure_count FROM brk")
def breaker_replay(spark, sf):
    return B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S)


STEPS = 5
#: Beyond all times of the tables; a row of that time ends a feed, so that the watermark passes all others.
CLOSING_US = 9_000_000_000_000_000


#: Bytes of a gzip file of nothing, which Spark writes for a job's first task.
_NOTHING = 20


def _drop_empty(spark, folder: str) -> None:
    """Files without a row do not arrive."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*.gz")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path):
        if found.getLen() <= _NOTHING:
            files.delete(found.getPath(), False)


def _feed(rows, name: str, closing: dict, wide: tuple[str, ...] = ()) -> tuple[str, str]:
    """(folder, delay): rows with ``ts_us`` as JSON files that arrive in steps, out of order by up to two steps.

    Each row falls in the step of its time or the next one, by its hash; within a step there is no order.
    Rows with ``wide`` columns are written where they are, and their step follows from the other columns, so that
    a wide value is made in the step that writes it alone and is in no exchange.
    """
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, name)
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    low, width = low or 0, ((high or 0) - (low or 0)) // (STEPS - 1) + 1
    digest = F.xxhash64(*[c for c in rows.columns if c not in wide])
    dealt = rows.withColumn("_step", F.floor((F.col("ts_us") - low + F.pmod(digest, F.lit(width))) / width))
    if not wide:
        dealt = dealt.repartition(4, digest)
    for step in range(STEPS + 1):
        W.write_jsonl(dealt.filter(F.col("_step") == step).drop("_step"), f"{folder}/{step}", **PACKED)
    _drop_empty(spark, folder)
    last = spark.range(1).select(*[F.lit(closing.get(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    W.write_jsonl(last.withColumn("ts_us", F.lit(CLOSING_US)), f"{folder}/last")
    return f"{folder}/*", f"{2 * width // 1_000_000 + 1} seconds"


def _run(rows, name: str):
    """All of a stream into Parquet, in as many batches as it takes."""
    spark = rows.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, "state")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _read_feed(spark, folder: str, schema: str):
    """A feed as a stream of about a batch per step; the last file closes it."""
    files = len(spark.read.schema(schema).json(folder).inputFiles()) - 1
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(4, -(-files // (STEPS + 1)))).json(folder)


def _stream_calls(spark, sf):
    """The calls as a stream of unordered files, in several batches."""
    folder, delay = _feed(D.calls(spark, sf), "calls", {"service": 0, "call_id": -1, "ok": True})
    calls = _read_feed(spark, folder, "service bigint, call_id bigint, ts_us bigint, ok boolean")
    return _run(B.stream_breaker(calls, THRESHOLD, RECOVERY_S, delay, RECOVERY_S), "outcomes")


@query("str2_breaker_stream", "STR-2",
       f"{_BREAKER} SELECT service, call_id, ts_us, ok, admitted, state, cnt AS failure_count FROM brk")
def breaker_stream(spark, sf):
    return _stream_calls(spark, sf)


@query("str3_health", "STR-3", f"""{_BREAKER} SELECT service, arg_max(state, rn) AS circuit_state,
  arg_max(cnt, rn) AS circuit_failures FROM brk GROUP BY service""")
def health(spark, sf):
    return B.health(B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S))


def _routed(fallback: bool) -> str:
    other = "'rules'" if fallback else "'error'"
    status = "200" if fallback else "CASE WHEN NOT admitted THEN 503 WHEN NOT ok THEN 502 ELSE 200 END"
    return (f"{_BREAKER} SELECT call_id, CASE WHEN admitted AND ok THEN 'model' ELSE {other} END AS route, "
            f"{status} AS status FROM brk")


@query("str4_routes_with_fallback", "STR-4", _routed(True))
def routes_with_fallback(spark, sf):
    rows = B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S)
    return B.route(rows, True).select("call_id", "route", "status")


@query("str4_routes_without_fallback", "STR-4", _routed(False))
def routes_without_fallback(spark, sf):
    rows = B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S)
    return B.route(rows, False).select("call_id", "route", "status")


@query("str4_rejects", "STR-4 PRJ-1", f"""WITH RECURSIVE {S.breaker(THRESHOLD, RECOVERY_S)}
SELECT call_id AS id, CASE WHEN NOT admitted THEN 503 ELSE 502 END AS status,
  CASE WHEN NOT admitted THEN 'Circuit breaker OPEN' ELSE 'Call to the model failed' END AS detail
FROM brk WHERE NOT (admitted AND ok)""")
def rejects(spark, sf):
    logs = D.sim_logs(spark, sf)
    routed = B.route(B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S), False)
    answered = OT.triage(
        logs.select("id", "log"), routed.withColumnRenamed("call_id", "id"), D.generated(logs)
    )
    return OT.rejected(answered)


def _timed_requests(spark, sf, texts=None):
    """(id, ts_us, log): the requests with the times of their calls, those without one at a time by their id.

    ``texts`` (id, columns...), if given, are columns of the requests too. Both are joined to what the logs are made
    from: narrow events, and documents, of which few or none have a call. What these get is stored, so Spark
    broadcasts it by its size and no text of a request is in an exchange.
    """
    times = D.calls(spark, sf).select(F.col("call_id").alias("id"), "ts_us")
    first = times.agg(F.min("ts_us")).first()[0] or 0
    at = F.coalesce("ts_us", F.lit(first) - F.col("id") * 1_000_000).alias("ts_us")
    given = times if texts is None else times.join(texts, "id", "full")
    more = [] if texts is None else [F.col(c) for c in texts.columns if c != "id"]
    events = D.table(spark, sf, "events").select("event_id", "event_type", F.col("event_id").alias("id"))
    events = stored(events.join(given, "id", "left").select("event_id", "event_type", at, *more), "timed_events")
    docs = D.table(spark, sf, "documents").select("doc_id", "text", (-1 - F.col("doc_id")).alias("id"))
    called = stored(given.join(docs.select("id"), "id", "left_semi"), "timed_documents")
    docs = docs.join(called, "id", "left").select("doc_id", "text", at, *more)
    kept = [F.col("ts_us"), *more]
    logs = D.sim_logs(spark, sf, *kept, rows=events).select("id", *kept, "log")
    longs = D.long_logs(spark, sf, *kept, rows=docs).select((-1 - F.col("id")).alias("id"), *kept, "log")
    return logs.unionByName(longs)


@query("str1_routed_triage", "STR-1 CLS-4", FULL_TRIAGE)
def routed_triage_stream(spark, sf):
    """Requests and the outcomes of their calls as two unordered streams, joined within the watermark."""
    replayed = B.replay_breaker(D.calls(spark, sf), THRESHOLD, RECOVERY_S)
    routed = B.route(replayed, False).select(F.col("call_id").alias("id"), "ts_us", "route", "status")
    outcomes, slow = _feed(stored(routed, "routed"), "outcomes", {"id": -(2**62)})
    requests = _timed_requests(spark, sf, D.generated(D.sim_logs(spark, sf)))
    asked, delay = _feed(requests, "requests", {"id": 2**62}, wide=("generated_text", "log"))
    at = F.timestamp_micros("ts_us").alias("at")
    answers = routed_triage(
        _read_feed(spark, asked, "id bigint, ts_us bigint, generated_text string, log string").select(
            "id", at, "generated_text", "log"
        ),
        _read_feed(spark, outcomes, "id bigint, ts_us bigint, route string, status int").select("id", at, "route", "status"),
        max(delay, slow, key=lambda d: int(d.split()[0])), "1 HOUR",
    )
    with state_on_disk(spark):
        return _run(answers, "answers")
