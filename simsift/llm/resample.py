"""Importance resampling towards a target distribution.

Texts become bags of hashed word runs. A bucket's gain is the logarithm of how much more often it stands in the
target texts than in the corpus; a document's weight is the sum of its features' gains. With Gumbel noise that
follows from seed and doc_id, the highest scores are a draw without replacement by those weights.

* Weights are scored on arrays: words, their checksums and those of the runs for a whole block of texts at once. The
  checksum of a run comes from those of its words, as crc32 is linear over bits.
* The draw needs no global sort. Scores are stored; the cutoff is found by bisection over the numbers, each step an exact
  count job over the narrow stored columns. Ties at the cutoff are cut in the same way by doc_id and, where rows
  share that too, by place in the scan. Only drawn rows are sorted, by ranges, for their ranks.

Words are runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII. A null or empty text has no
feature, weight 0 and a score of noise alone; it is drawn only if ``least_words`` is 0. A text counts whole. A null doc_id is hashed as an
empty string and comes after all others in a tie; rows that repeat a doc_id share their noise and are drawn one by one.
An empty corpus or target gives counts of 0 and defined gains. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shards import number_rows
from .vocabulary import blocks

_WORD = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_IS_WORD = bytes(b in _WORD for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Longer words are few and go to zlib one by one.
_STEPS = 48
#: Thresholds a counting job tries at once.
SECTIONS = 16


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 3
    seed: int = 42
    least_words: int = 20
    percent: int = 5


# ---- checksums of word runs -------------------------------------------------------

@cache
def _zeros(k: int) -> np.ndarray:
    """Tables, one per byte of a checksum, of what 2**k zero bytes after it make of it."""
    if k == 0:
        tables = np.arange(256, dtype=np.uint32) << np.uint32([[0], [0], [8], [16]])
        tables[0] = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]
        return tables
    return _followed(_zeros(k - 1), _zeros(k - 1))


def _followed(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums' part in those of texts that go on for ``lengths`` bytes."""
    crc, k = crc.copy(), 0
    while (rest := lengths >> k).any():
        at = np.flatnonzero(rest & 1)
        crc[at] = _followed(crc[at], _zeros(k))
        k += 1
    return crc


def word_crcs(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word, byte place by byte place over all words that reach it."""
    raw, shortness = np.frombuffer(data, dtype=np.uint8), 255 - np.minimum(lengths, 255).astype(np.uint8)
    order = np.argsort(shortness, kind="stable")
    at, size = starts[order], lengths[order]
    crc, step = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32), _zeros(0)[0]
    shortness = shortness[order]
    for k in range(_STEPS):
        n = np.searchsorted(shortness, 255 - k)  # words longer than k
        if not n:
            break
        crc[:n] = step[(crc[:n] ^ raw[at[:n] + k]) & 255] ^ crc[:n] >> 8
    crc ^= 0xFFFFFFFF
    for i in range(np.searchsorted(shortness, 255 - _STEPS)):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: list[bytes], spec: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text it is of, words of each text)."""
    data = b" ".join(texts).translate(_LOWER) + b" "
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    edges = np.diff(np.frombuffer(data.translate(_IS_WORD), dtype=np.int8), prepend=0)
    starts = np.flatnonzero(edges == 1)
    lengths = np.flatnonzero(edges == -1) - starts
    of = np.searchsorted(text_ends, starts, "right")
    words = word_crcs(data, starts, lengths)
    spaced = shifted(np.full_like(words, zlib.crc32(b" ")), lengths) ^ words
    run, found, owners = words, [words], [of]
    for more in range(1, spec.longest):
        run = shifted(run[:-1], lengths[more:] + 1) ^ spaced[more:]
        same = of[more:] == of[: len(of) - more]
        found.append(run[same])
        owners.append(of[more:][same])
    return np.concatenate(found) % spec.buckets, np.concatenate(owners), np.bincount(of, minlength=len(texts))


# ---- gains and scores ---------------------------------------------------------------

def bucket_counts(texts: DataFrame, spec: Resampling = Resampling(), text: str = "text") -> np.ndarray:
    """Features per bucket over all rows; tasks add up their own, so ``buckets`` rows a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(spec.buckets, dtype=np.int64)
        for batch in batches:
            for _, part in blocks(batch, 0):
                n += np.bincount(features(part, spec)[0], minlength=spec.buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n[held])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket bigint, n bigint")
    counts = np.zeros(spec.buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)), both with one added per bucket."""
    all_s, all_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = (target + 1.0) * all_s / ((corpus + 1.0) * all_t)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel number) that follows from seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighted(
    docs: DataFrame, gains: np.ndarray, spec: Resampling = Resampling(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in blocks(batch, 1):
                bucket, of, n_words = features(part, spec)
                weight = np.zeros(len(part), dtype=np.int64)
                np.add.at(weight, of, gains[bucket])
                n = np.bincount(of, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_words), pa.array(n), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


# ---- the draw -------------------------------------------------------------------------

def cutoff(rows: DataFrame, key: str, k: int, sections: int = SECTIONS) -> tuple[int, int]:
    """(least value v with at least k rows of key <= v, rows of key < v), for 1 <= k <= rows.

    Bisection in ``sections`` parts a step: each job counts the rows up to some values between
    the bounds, exactly, and the bounds close in on the part that holds the k-th.
    """
    low, high, below = *rows.agg(F.min(key), F.max(key)).first(), 0
    while low < high:
        span = high - low
        tried = sorted({low + span * i // sections for i in range(sections)})
        counts = rows.filter(F.col(key).between(low, high)).agg(*[F.count_if(F.col(key) <= v) for v in tried]).first()
        reached = [below + n >= k for n in counts]
        i = reached.index(True) if any(reached) else len(tried)
        low, high, below = (
            tried[i - 1] + 1 if i else low,
            tried[i] if i < len(tried) else high,
            below + (counts[i - 1] if i else 0),
        )
    return low, below


def ranked_draw(scored: DataFrame, k: int, eligible: Column, sections: int = SECTIONS) -> DataFrame:
    """scored (doc_id, score, ...) with ``rank`` 1 to k of the k highest scores among the eligible rows, else null.

    Ties go to the smaller doc_id. Column names with a leading underscore are the operator's own.
    """
    table = stored(
        scored.withColumns({
            "_fits": eligible, "_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(2**63 - 1)),
            "_scan": F.monotonically_increasing_id(),
        }), "scored",
    )
    own = ["_fits", "_down", "_id", "_scan"]
    rest, taken = table.filter("_fits"), F.lit(False)
    if k > 0:
        equal = F.col("_fits")
        for key in own[1:]:
            value, below = cutoff(rest, key, k, sections)
            taken = taken | (equal & (F.col(key) < value))
            equal, k, rest = equal & (F.col(key) == value), k - below, rest.filter(F.col(key) == value)
        taken = taken | equal
    left = table.filter(~taken).withColumn("rank", F.lit(None).cast("bigint")).drop(*own)
    numbered, _ = number_rows(table.filter(taken), own[1:], "rank")
    return left.unionByName(numbered.withColumn("rank", F.col("rank") + 1).drop(*own))


def resampled(
    docs: DataFrame, target: DataFrame, spec: Resampling = Resampling(),
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null where it is not drawn."""
    gains = bucket_gains(bucket_counts(docs, spec, text), bucket_counts(target, spec, target_text))
    scored = stored(
        weighted(docs, gains, spec, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), spec.seed)),
        "weighted",
    )
    eligible = F.col("n_words") >= spec.least_words
    n = scored.filter(eligible).count()
    return ranked_draw(scored, spec.percent * n // 100, eligible)
