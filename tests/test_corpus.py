"""Corpus generation, augmentation and split."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from simsift.catalog.labels import MODULES
from simsift.catalog.mutations import SPECS
from simsift.catalog.templates import log_templates
from simsift.operators import generate as GN
from simsift.operators.augment import augment
from simsift.operators import split as split_module
from simsift.operators.positions import with_position
from simsift.operators.split import label_ranks, shuffled, split_sizes, stratified_split

BASE = [
    (i, f"log {i}", label, "why", 1.0, "fifo", "m")
    for i, label in enumerate(["Off-by-One Error", "Parity Check Removal", "Never Heard Of", None])
]
BASE_TYPE = "id int, log string, label string, explanation string, confidence double, module string, mutation_id string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(BASE, BASE_TYPE)


def test_augment_counts_and_flags(base):
    rows = augment(base, ["id"], n_aug=5).collect()
    assert len(rows) == 4 * 6
    variants = [r for r in rows if r["augmented"]]
    assert Counter(r["id"] for r in variants) == {i: 5 for i in range(4)}
    assert {r["aug_id"] for r in variants} == set(range(5))
    assert all(r["module"] in MODULES and r["mutation_id"] == "m" for r in variants)
    kept = [r for r in rows if r["augmented"] is None]
    assert sorted(r["log"] for r in kept) == sorted(r[1] for r in BASE)
    assert all(r["aug_id"] is None for r in kept)
    marks = re.compile(r"\{(?!addr:04x|data:02x)\w*\}|%\d")
    assert not any(marks.search(r["log"]) for r in variants)


def test_augment_is_reproducible_and_seeded(base):
    logs = lambda df: sorted(r["log"] for r in df.collect())
    again = augment(base.repartition(3), ["id"], n_aug=4, seed=7)
    assert logs(augment(base, ["id"], n_aug=4, seed=7)) == logs(again)
    assert logs(augment(base, ["id"], n_aug=4, seed=8)) != logs(again)


def test_augment_by_nothing(base):
    assert augment(base, ["id"], n_aug=0).count() == 4
    with pytest.raises(ValueError, match="n_aug"):
        augment(base, ["id"], n_aug=-1)


def test_noise_share(spark):
    rows = spark.range(2000).select(
        "id", F.lit("x").alias("log"), F.lit("Off-by-One Error").alias("label"), F.lit("fifo").alias("module")
    )
    logs = [r["log"] for r in augment(rows, ["id"], n_aug=1).filter("augmented").collect()]
    lines = Counter(len(log.split("\n")) for log in logs)
    assert set(lines) == {2, 3, 4, 5, 6}
    assert 0.45 < lines[2] / len(logs) < 0.55


def test_corpus_from_the_catalogue(spark):
    sources = spark.createDataFrame([(m,) for m in (*MODULES, "other")], "module string")
    rows = GN.generate_corpus(sources).collect()
    assert len(rows) == 6 * 9
    assert {r["label_source"] for r in rows} == {"mutation"} and not any(r["is_inert"] for r in rows)
    assert Counter(r["label"] for r in rows) == {s.label: 6 for s in SPECS}
    other = next(r for r in rows if r["module"] == "other")
    assert other["mutation_id"] in other["log"] and "module=other" in other["log"]


def test_all_pairs_have_a_template():
    assert len({(m, s) for m, s, _ in log_templates()}) == 45


def test_corpus_from_runs(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "module string")
    golden = spark.createDataFrame(
        [("a", "seed = 1 fine", True), ("b", "broken", False)], "module string, log string, ok boolean"
    )
    first, second, third = SPECS[0].mutation_id, SPECS[1].mutation_id, SPECS[2].mutation_id
    runs = spark.createDataFrame(
        [("a", first, "seed = 2  fine", True), ("a", second, "parity error", True), ("a", third, "seed = 3 fine", False)],
        "module string, mutation_id string, log string, ok boolean",
    )
    rows = GN.generate_corpus(sources, runs, golden).collect()
    a = {r["mutation_id"]: r for r in rows if r["module"] == "a"}
    assert first not in a and len(a) == 8  # the inert run is dropped
    assert a[second]["label"] == "Parity Check Removal" and a[second]["label_source"] == "log_parser"
    assert not a[third]["is_inert"]  # a failed run is never inert
    b = [r for r in rows if r["module"] == "b"]
    assert len(b) == 9 and {r["label_source"] for r in b} == {"mutation"}
    with_inert = GN.generate_corpus(sources, runs, golden, include_inert=True)
    assert with_inert.filter("is_inert").count() == 1


SIZES = {1: (1, 0, 0), 2: (1, 1, 0), 3: (2, 1, 0), 4: (3, 1, 0), 5: (4, 1, 0), 6: (4, 1, 1), 45: (31, 7, 7), 85: (59, 13, 13)}


def test_split_sizes(spark):
    rows = spark.createDataFrame([(n,) for n in SIZES], "n bigint").withColumns(split_sizes(F.col("n"), 0.70, 0.15))
    assert {r["n"]: (r["n_train"], r["n_val"]) for r in rows.collect()} == {n: s[:2] for n, s in SIZES.items()}


@pytest.mark.parametrize("limit", [1, 16, 1 << 16])
def test_split_is_an_exact_partition(spark, limit):
    data = [(f"{n}-{i}", f"L{n}" if n != 6 else None) for n in SIZES for i in range(n)]
    rows = spark.createDataFrame(data, "id string, label string").repartition(5)
    out = stratified_split(rows, ["id"], limit=limit).collect()
    assert sorted(r["id"] for r in out) == sorted(d[0] for d in data)
    counts = Counter((r["label"], r["split"]) for r in out)
    for n, sizes in SIZES.items():
        label = f"L{n}" if n != 6 else None
        assert tuple(counts[(label, s)] for s in ("train", "val", "test")) == sizes
    # The split follows the seeded ranks.
    ranks = {r["id"]: r["rank"] for r in label_ranks(rows, ["id"], limit=limit).collect()}
    for r in out:
        n = int(r["id"].split("-")[0])
        train, val, _ = SIZES[n]
        assert r["split"] == ("train" if ranks[r["id"]] <= train else "val" if ranks[r["id"]] <= train + val else "test")


def test_split_with_one_hot_label(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("label"))
    out = stratified_split(rows, ["id"])
    total = out.groupBy("split").count().collect()
    assert sum(r["count"] for r in total) == 20_000
    hot = {r["split"]: r["count"] for r in out.filter("label = 'hot'").groupBy("split").count().collect()}
    n = 13_333
    assert hot["train"] == round(n * 0.7) and hot["val"] == round(n * 0.15)


def test_windows_stay_small_with_one_label(spark):
    rows, limit = spark.range(30_000).select("id", F.lit("L").alias("label")), 64
    keyed, digits = split_module._keyed(rows, ["id"], "label", 42, limit)
    counts = [r["count"] for r in keyed.groupBy("_label", "_range").count().collect()]
    assert digits > 2 and max(counts) <= limit  # rows of a ranking window
    siblings = keyed.select("_range").distinct().groupBy(F.substring("_range", 1, max(0, digits - 3)).alias("p")).count()
    assert siblings.agg(F.max("count")).first()[0] <= 4096  # ranges of a summing window
    ranks = {r["id"]: r["rank"] for r in label_ranks(rows, ["id"], limit=limit).collect()}
    keys = {r["id"]: r["k"] for r in rows.select("id", split_module.shuffle_key(["id"], 42).alias("k")).collect()}
    assert [ranks[i] for i in sorted(keys, key=keys.get)] == list(range(1, 30_001))
    sizes = {r["split"]: r["count"] for r in stratified_split(rows, ["id"], limit=limit).groupBy("split").count().collect()}
    assert sizes == {"train": 21_000, "val": 4_500, "test": 4_500}


def test_positions_of_ties_and_nulls(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, IF(id % 5 = 0, NULL, id)) AS k", "id")
    got = with_position(rows, ["k"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 3001))
    keys = [(r["k"] is not None, r["k"] or 0) for r in got]
    assert keys == sorted(keys)
    assert with_position(rows.limit(0), ["k"]).count() == 0


def test_ambiguous_key_is_refused(spark):
    rows = spark.createDataFrame([("same", "L")] * 10, "id string, label string")
    with pytest.raises(Exception, match="not unique"):
        stratified_split(rows, ["id"]).collect()


def test_ratios_above_one(spark):
    rows = spark.range(20).select("id", F.lit("L").alias("label"))
    out = stratified_split(rows, ["id"], train_ratio=0.9, val_ratio=0.4)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 18, "val": 1, "test": 1}


def test_final_order_is_seeded(spark):
    rows = stratified_split(spark.range(50).select("id", F.lit("L").alias("label")), ["id"])
    order = lambda s: [r["id"] for r in shuffled(rows, ["id"], s).orderBy("position").collect()]
    assert order(1) == order(1) != order(2)
