"""Breaker fold, parallel replay of hot services, stream equals table."""

import functools
import random

import numpy as np
import pandas as pd
import pytest

from simsift.sources.writers import write_jsonl
from simsift.streaming import breaker as breaker_module
from simsift.streaming import scan
from simsift.streaming.breaker import health, replay_breaker, route, stream_breaker
from simsift.streaming.fold import CLOSED, HALF_OPEN, OPEN, Breaker, fold_calls

NAMES = {CLOSED: "CLOSED", OPEN: "OPEN", HALF_OPEN: "HALF_OPEN"}


def one_by_one(calls, threshold, recovery):
    """The transition table, call by call."""
    mode, count, last, out = CLOSED, 0, None, []
    for ts, ok in calls:
        if mode == OPEN and not (last is not None and ts - last > recovery):
            out.append((False, mode, count))
            continue
        half = mode == OPEN
        if ok:
            mode, count = CLOSED, (0 if half else count)
        else:
            count, last = count + 1, ts
            mode = OPEN if count >= threshold else (HALF_OPEN if half else CLOSED)
        out.append((True, mode, count))
    return out


def fold(calls, threshold, recovery, start=Breaker()):
    ts = np.array([c[0] for c in calls], dtype=np.int64)
    ok = np.array([c[1] for c in calls], dtype=bool)
    a, m, c, end = fold_calls(ts, ok, start, threshold, recovery)
    return [(bool(x), int(y), int(z)) for x, y, z in zip(a, m, c, strict=True)], end


def test_fold_equals_call_by_call():
    rng = random.Random(1)
    for _ in range(500):
        ts, calls = 0, []
        for _ in range(rng.randint(1, 60)):
            ts += rng.choice([0, 1, 5, 10, 11])
            calls.append((ts, rng.random() > rng.choice([0.1, 0.5, 0.9])))
        threshold, recovery = rng.randint(1, 5), rng.choice([0, 5, 10, 30])
        want = one_by_one(calls, threshold, recovery)
        assert fold(calls, threshold, recovery)[0] == want
        cut = rng.randint(0, len(calls))
        head, state = fold(calls[:cut], threshold, recovery)
        assert head + fold(calls[cut:], threshold, recovery, state)[0] == want


def test_recovery_time_is_strict():
    states = [r[:2] for r in fold([(0, False), (60, True), (61, True)], 1, 60)[0]]
    assert states == [(True, OPEN), (False, OPEN), (True, CLOSED)]


def test_success_does_not_clear_the_count():
    assert [r[2] for r in fold([(0, False), (1, True), (2, False)], 5, 60)[0]] == [1, 1, 2]


def test_failed_probe_opens_again():
    out, _ = fold([(0, False), (100, False), (101, True)], 1, 60)
    assert out == [(True, OPEN, 1), (True, OPEN, 2), (False, OPEN, 2)]


def make_calls(n, seed):
    """Service 'hot' holds most calls."""
    rng = random.Random(seed)
    ts, rows = 0, []
    for i in range(n):
        ts += rng.choice([0, 1_000_000, 7_000_000])
        service = "hot" if rng.random() < 0.7 else f"s{rng.randint(0, 4)}"
        rows.append((service, i, ts, rng.random() > 0.3))
    return rows


CALLS = "service string, call_id bigint, ts_us bigint, ok boolean"


def expected(rows, threshold, recovery_s):
    by, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by.setdefault(r[0], []).append(r)
    for calls in by.values():
        folded = one_by_one([(r[2], r[3]) for r in calls], threshold, recovery_s * 1_000_000)
        out.update({r[1]: (f[0], NAMES[f[1]], f[2]) for r, f in zip(calls, folded, strict=True)})
    return out


@pytest.mark.parametrize(("chunks", "recovery"), [(1, 30), (7, 30), (16, 600), (40, 3)])
def test_replay_of_a_hot_service(spark, chunks, recovery):
    rows = make_calls(3000, chunks)
    calls = spark.createDataFrame(rows, CALLS).repartition(5)
    got = replay_breaker(calls, 3, recovery, chunks).collect()
    assert {r["call_id"]: (r["admitted"], r["state"], r["failure_count"]) for r in got} == expected(rows, 3, recovery)


@pytest.mark.parametrize("fan", [2, 3])
def test_replay_over_many_levels(spark, fan):
    rows = make_calls(2000, 31)
    calls = spark.createDataFrame(rows, CALLS).repartition(5)
    got = replay_breaker(calls, 4, 45, 24, fan).collect()
    assert {r["call_id"]: (r["admitted"], r["state"], r["failure_count"]) for r in got} == expected(rows, 4, 45)


def test_jobs_do_not_grow_with_the_chunks_of_a_healthy_service(spark):
    """One call in 10,000 fails: each chunk's end depends on the one before, through all of them."""
    rows = [("one", i, i * 1_000_000, i % 10_000 != 77) for i in range(60_000)]
    calls = spark.createDataFrame(rows, CALLS).repartition(4).persist()
    jobs = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for chunks in (8, 200):
            spark.sparkContext.setJobGroup(f"replay{chunks}", "")
            got = replay_breaker(calls, 3, 600, chunks).filter("state != 'CLOSED' OR NOT ok").collect()
            jobs[chunks] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"replay{chunks}"))
            want = {k: v for k, v in expected(rows, 3, 600).items() if v[1] != "CLOSED" or k % 10_000 == 77}
            assert {r["call_id"]: (r["admitted"], r["state"], r["failure_count"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setJobGroup("", "")
        calls.unpersist()
    assert jobs[200] <= 2 * jobs[8]  # one level more of 64


def test_summaries_chain_like_the_calls_themselves():
    rng = random.Random(3)
    for _ in range(1500):
        n, p = rng.randint(1, 60), rng.choice([0.02, 0.3, 0.6, 0.95])
        ts = np.cumsum([rng.choice([0, 1, 5, 10, 11]) for _ in range(n)]).astype(np.int64)
        ok = np.array([rng.random() > p for _ in range(n)])
        threshold, recovery = rng.randint(0, 5), rng.choice([0, 5, 10, 30, 100])
        bounds = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6)))), n]
        parts = [scan.summarise(ts[a:b], ok[a:b], threshold, recovery) for a, b in zip(bounds, bounds[1:])]
        whole = scan.from_rows(scan.to_rows(1, functools.reduce(scan.chained, parts)).sample(frac=1, random_state=1))
        opened = Breaker(OPEN, max(threshold, 1) + rng.randint(0, 3), int(ts[0]) - rng.choice([0, 1, 3, 9, 40, 200]))
        for start in (opened, *(Breaker(CLOSED, c, -1) for c in range(max(threshold, 1)))):
            *_, want = fold_calls(ts, ok, start, threshold, recovery)
            for end in (scan.after(start, whole), functools.reduce(scan.after, parts, start)):
                assert (end.mode, end.failures) == (want.mode, want.failures)
                assert end.mode == CLOSED or end.last_failure == want.last_failure


def test_a_summary_is_small_where_failures_are_rare():
    ts = np.arange(100_000, dtype=np.int64) * 1000
    ok = np.ones(len(ts), dtype=bool)
    ok[::1000] = False
    summary = scan.summarise(ts, ok, 5, 20_000_000)  # the recovery time holds 20 failures
    assert len(summary.bounds) <= 2 * 20 + 3


def test_replay_of_nothing(spark):
    assert replay_breaker(spark.createDataFrame([], CALLS)).count() == 0


def streamed(spark, rows, folder, delay_s, slot_s, parts):
    """Outcomes of a stream that gets ``parts`` file by file, then a mark that closes it."""
    for i, part in enumerate([*parts, [("close", -1, 10**15, True)]]):
        write_jsonl(spark.createDataFrame(part, CALLS).coalesce(1), f"{folder}/in/{i:02}")
    files = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
    run = stream_breaker(files, 3, 30, f"{delay_s} seconds", slot_s).writeStream.format("parquet").option(
        "path", f"{folder}/out"
    ).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").collect()
    batches = [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]]
    return got, batches


@pytest.mark.parametrize("slot_s", [20, 3600])
def test_unordered_stream_equals_replay(spark, tmp_path, slot_s):
    rows, rng = make_calls(900, 5), random.Random(slot_s)
    width = max(r[2] for r in rows) / 4
    parts = [[] for _ in range(6)]
    for r in rows:  # in the file of its time or one later
        parts[int(r[2] / width + rng.random())].append(r)
    for part in parts:
        rng.shuffle(part)
    parts = [p for p in parts if p]
    got, batches = streamed(spark, rows, str(tmp_path), int(2 * width / 1e6) + 1, slot_s, parts)
    assert len(batches) >= 5 and len(got) == len(rows)
    assert {r["call_id"]: (r["admitted"], r["state"], r["failure_count"]) for r in got} == expected(rows, 3, 30)


def test_calls_beyond_the_delay_are_dropped(spark, tmp_path):
    on_time = [("a", i, i * 10_000_000, i % 2 == 0) for i in range(1, 41)]
    got, _ = streamed(spark, on_time, str(tmp_path), 5, 1, [on_time[:20], on_time[20:], [("a", 99, 1, False)]])
    assert {r["call_id"]: (r["admitted"], r["state"], r["failure_count"]) for r in got} == expected(on_time, 3, 30)


def test_a_frame_holds_one_slot():
    """The processor on a state of its own: parts are stored as they come, a timer reads its slot's alone."""

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    class Handle:
        timers, maps = [], {}

        def getValueState(self, *_):
            held = Map()
            held.exists, held.get, held.update = (lambda: 0 in held), (lambda: held[0]), (lambda v: held.__setitem__(0, v))
            return held

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Map())

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    handle, rng = Handle(), random.Random(1)
    processor = breaker_module._OrderedCalls(3, 30_000_000, 60_000_000)
    processor.init(handle)
    rows = [("s", i, i * 1_000_000, rng.random() > 0.4) for i in range(600)]
    shuffled = rng.sample(rows, len(rows))
    for a in range(0, 600, 50):
        frame = pd.DataFrame(shuffled[a : a + 50], columns=["service", "call_id", "ts_us", "ok"])
        assert all(f.empty for f in processor.handleInputRows(("s",), iter([frame]), At))
    assert sorted(handle.timers) == [60_000 * k for k in range(1, 11)]
    out = []
    for at in sorted(handle.timers):
        expired = type("Expired", (), {"getExpiryTimeInMs": lambda self, at=at: at})()
        out += [f for f in processor.handleExpiredTimer(("s",), At, expired)]
    assert [len(f) for f in out] == [60] * 10 and not handle.maps["parts"] and not handle.maps["sizes"]
    got = pd.concat(out)
    assert {r.call_id: (r.admitted, r.state, r.failure_count) for r in got.itertuples()} == expected(rows, 3, 30)


def test_health_and_routes(spark):
    calls = spark.createDataFrame([("m", 0, 0, False), ("m", 1, 1, True)], CALLS)
    outcomes = replay_breaker(calls, 1, 3600)
    assert tuple(health(outcomes).first()) == ("m", "OPEN", 1)
    with_rules = route(outcomes, True).orderBy("call_id").collect()
    assert [(r["route"], r["status"]) for r in with_rules] == [("rules", 200), ("rules", 200)]
    without = route(outcomes, False).orderBy("call_id").collect()
    assert [(r["route"], r["status"]) for r in without] == [("error", 502), ("error", 503)]


def test_health_of_a_stream(spark, tmp_path):
    rows = make_calls(200, 9)
    streamed(spark, rows, str(tmp_path), 60, 3600, [rows])
    outcomes = spark.readStream.schema(spark.read.parquet(str(tmp_path / "out")).schema).parquet(str(tmp_path / "out"))
    health(outcomes).writeStream.format("memory").queryName("health_now").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "s2")
    ).trigger(availableNow=True).start().awaitTermination()
    want = health(replay_breaker(spark.createDataFrame(rows, CALLS), 3, 30)).collect()
    assert {tuple(r) for r in spark.table("health_now").collect()} == {tuple(r) for r in want}
