"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simsift.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score string, rank int, weight string, _id int"


def buckets(text, spec):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, spec.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % spec.buckets for r in runs]


def brute(docs, target, spec=R.Resampling()):
    s, t = Counter(), Counter()
    for text in target:
        t.update(buckets(text, spec)[1])
    read = [(doc_id, *buckets(text, spec)) for doc_id, text in docs]
    for _, _, found in read:
        s.update(found)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + spec.buckets) / ((s[b] + 1) * (n_t + spec.buckets))))
    rows = []
    for doc_id, n_words, found in read:
        h = int(hashlib.sha256(f"{spec.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= spec.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: spec.percent * len(fit) // 100]
    return sorted(
        [(*r, None) for r in rows if not any(r is d for d in drawn)] + [(*r, i + 1) for i, r in enumerate(drawn)], key=repr
    )


def table(spark, docs):
    return spark.createDataFrame([(a, b, "x", 1, "w", 3) for a, b in docs], SCHEMA).repartition(4)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("spec", [R.Resampling(), R.Resampling(50, 5, 7, 3, 40), R.Resampling(97, 1, 1, 0, 100)])
def test_equals_brute_force(spark, spec):
    draw = random.Random(4)
    pool = ["The", "the", "été", "x1", "don't", "日本", "a" * 47, "b" * 48, "c" * 49, "d" * 300, "A-B", "ß_ß", "9", " "]
    docs = [(i, draw.choice([" ", "\n", " . ", "\x00"]).join(draw.choices(pool, k=draw.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " -- "), (303, "long one " * 50_000), (304, "e" * 70_000), (None, "no id " * 30)]
    target = ["The été x1 " * 5, None, "", "日本 don't stop"]
    got = rows_of(R.resampled(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), spec))
    assert got == brute(docs, target, spec)
    assert len(got) == len(docs)


def test_repeated_rows_and_ties_are_drawn_exactly(spark):
    # a third of the rows is one row, another third shares its text under one doc_id more
    docs = [(5, "same words here again " * 6)] * 200 + [(i % 2 + 6, "other words here again " * 6) for i in range(200)]
    docs += [(None, "null words here again " * 6)] * 20 + [(100 + i, f"word{i} " * 25) for i in range(180)]
    target = spark.createDataFrame([("same words other null",)], "text string")
    for percent in (1, 17, 34, 50, 99):
        spec = R.Resampling(percent=percent)
        got = rows_of(R.resampled(table(spark, docs), target, spec))
        assert got == brute(docs, ["same words other null"], spec)


@pytest.mark.parametrize("sections", [2, 3, 16])
def test_cutoff_over_the_whole_range_of_numbers(spark, sections):
    values = [-(2**63), -(2**63), -5, 0, 0, 0, 1, 7, 2**63 - 1, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 3, 4, 6, 8, 9, 10):
        assert R.cutoff(rows, "v", k, sections) == (values[k - 1], sum(v < values[k - 1] for v in values))


def test_empty_tables(spark):
    docs, target = table(spark, [(1, "one two three " * 10)]), spark.createDataFrame([], "text string")
    assert rows_of(R.resampled(docs.limit(0), target)) == []
    assert rows_of(R.resampled(docs, target)) == brute([(1, "one two three " * 10)], [])


def test_rank_is_the_order_of_scores_in_many_partitions(spark):
    scored = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 501).alias("score"))
    drawn = R.ranked_draw(scored, 7_000, F.col("doc_id") % 2 == 0).filter("rank IS NOT NULL").orderBy("rank").collect()
    wanted = sorted(((-(i * 7919 % 501), i) for i in range(0, 20_000, 2)))[:7_000]
    assert [(r.rank, -r.score, r.doc_id) for r in drawn] == [(k + 1, *w) for k, w in enumerate(wanted)]


def test_checksums_of_runs():
    draw = random.Random(2)
    for _ in range(200):
        a, b = draw.randbytes(draw.randint(0, 80)), draw.randbytes(draw.randint(0, 5000))
        joined = R.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert int(joined[0]) == zlib.crc32(a + b)
