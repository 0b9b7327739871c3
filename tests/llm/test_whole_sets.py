"""Set join: components meet in a list by whatever sizes of theirs fit."""

from pyspark.sql import functions as F

from simsift.llm import jaccard


def members(spark, rows):
    schema = "key bigint, m struct<id: bigint, size: float, small: boolean>, hub bigint"
    return spark.createDataFrame([(k, (i, float(n), True), h) for k, i, n, h in rows], schema)


def hub_pairs(spark, rows, edge=10**6):
    return {(r["a"], r["b"]) for r in jaccard._hub_pairs(members(spark, rows), edge).collect()}


def test_component_of_wide_sizes_meets_one_that_fits_its_largest(spark):
    chain = [(1, 10, 100, 1), (1, 11, 80, 1), (1, 12, 64, 1)]
    assert hub_pairs(spark, chain + [(1, 20, 100, 2)]) == {(1, 2)}
    # and its smallest, and one in between
    assert hub_pairs(spark, chain + [(1, 20, 50, 2)]) == {(1, 2)}
    assert hub_pairs(spark, chain + [(1, 20, 85, 2)]) == {(1, 2)}
    # sizes that fit none of it
    assert hub_pairs(spark, chain + [(1, 20, 200, 2), (1, 30, 30, 3)]) == set()


def test_growing_and_truncated_copies_equal_all_pairs(spark):
    from test_other_ops import docs, plain_components, plain_set

    texts = []
    for f in range(6):
        words = [f"w{f}x{i}" for i in range(200)]
        shift = [f"v{f}x{i}" for i in range(12)]
        texts += [" ".join(words[:n]) for n in (52, 64, 80, 100, 125, 156)]  # a growing page
        texts += [" ".join(shift + words[12:n]) for n in (104, 84, 68)]  # another beginning, truncated
    rows = list(enumerate(texts))
    sets = [plain_set(t) for t in texts]
    group = plain_components(rows, lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    frame = docs(spark, rows).repartition(4)
    for turns in (1, 2):
        out = jaccard.similar_sets(frame, join=jaccard.Join(cells=18, turns=turns))
        got = {r["doc_id"]: r["component_id"] for r in out.select("doc_id", F.col("component_id")).collect()}
        assert got == {i: least[g] for (i, _), g in zip(rows, group)}
