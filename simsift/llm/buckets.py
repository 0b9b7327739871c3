"""Grouping of very many fixed-size (key, member) entries on few shuffled rows.

A task packs its entries by key bucket into one binary value per bucket; a bucket's values
meet in one task, which sorts them with numpy. Buckets are a fixed multiple of the session's
shuffle partitions, so they are sized like those.

A key may occur in any number of rows. Each task therefore combines first: of the members
that it holds for a key, all are paired with the least, and only that one is sent to the key's
bucket, which gets one entry per key and task at most. The members of keys that have several go
along as plain rows, dealt by task: these name who met under a key, whatever was paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PER_PARTITION = 4
CHUNK = 1 << 18  # entries of a row that is dealt by task
PAIRS, HEADS, MEMBERS = range(3)
ENTRIES = "bucket int, kind int, data binary"


def bucket_count(df: DataFrame) -> int:
    return PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def linked(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, first, several): per key its members paired with the least and with the next; first: one entry per key;
    several: the entries of keys with two members or more.

    keys and members are parallel; ``first`` and ``several`` index them.
    """
    order = np.lexsort((members, keys))
    k, m = keys[order], members[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = m[start][group]
    most = m[np.append(start[1:], len(k)) - 1][group]
    rest = np.flatnonzero(~new)
    a = np.concatenate([least[rest], m[rest - 1]])
    b = np.concatenate([m[rest], m[rest]])
    differ = a != b
    return a[differ], b[differ], order[start], order[least != most]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def entries(keys: np.ndarray, members: np.ndarray, n_buckets: int, task: int):
    """Rows of ``ENTRIES`` for one task's entries."""
    a, b, first, several = linked(keys, members)
    pairs = _unique_pairs(a, b)
    if len(pairs):
        yield _row(task % n_buckets, PAIRS, pairs)
    met = np.stack([keys[several], members[several]], axis=1)
    for i, low in enumerate(range(0, len(met), CHUNK)):
        yield _row((task + i) % n_buckets, MEMBERS, met[low : low + CHUNK])
    k, m = keys[first], members[first]
    bucket = (k.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    both = np.stack([k[order], m[order]], axis=1)
    for i in range(n_buckets):
        if bounds[i] < bounds[i + 1]:
            yield _row(i, HEADS, both[bounds[i] : bounds[i + 1]])


def _row(bucket: int, kind: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()),
            pa.array([np.ascontiguousarray(data).tobytes()], pa.binary()),
        ],
        names=["bucket", "kind", "data"],
    )


def _met(table: pa.Table) -> pa.Table:
    parts = {PAIRS: [], HEADS: [], MEMBERS: []}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data")):
        parts[kind].append(np.frombuffer(data.as_buffer(), dtype=np.int64).reshape(-1, 2))
    none = np.zeros((0, 2), dtype=np.int64)
    both = np.concatenate([none, *parts[HEADS]])
    keys, members = both[:, 0].copy(), both[:, 1].copy()
    a, b, _, several = linked(keys, members)
    ends = np.concatenate([none, *parts[PAIRS], np.stack([a, b], axis=1)])
    pairs = _unique_pairs(ends[:, 0], ends[:, 1])
    met = np.concatenate([none, *parts[MEMBERS], np.stack([keys[several], members[several]], axis=1)])
    # a head stands in its task's members too, and a member in those of several tasks
    met = np.unique(met, axis=0) if len(met) else met
    out = np.concatenate([pairs, met])
    return pa.table(
        {
            "pairs": pa.array(np.arange(len(out)) < len(pairs)),
            "a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64()),
        }
    )


def meetings(rows: DataFrame) -> DataFrame:
    """(pairs, a, b): with ``pairs`` members of one key, a < b, each paired with the key's least and with the next;
    without, all (key, member) of keys with several members. Rows may repeat.
    """
    return rows.groupBy("bucket").applyInArrow(_met, "pairs boolean, a bigint, b bigint")
