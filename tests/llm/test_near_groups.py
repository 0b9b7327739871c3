"""Groups of near copies: few comparisons where counts of shingles settle a pair; workers remember what is in use."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from simsift.llm import jaccard, vocabulary

from test_other_ops import docs, plain_components, plain_set


def variants(rng, count, edits):
    """Copies of one text, each with words of its own in some places."""
    base = [f"w{i}" for i in range(140)]
    out = []
    for v in range(count):
        own = base[:]
        for e in range(rng.choice(edits)):
            own[7 * rng.randrange(20) + 3] = f"v{v}x{e}"
        out.append(" ".join(own))
    return out


def joined(spark, texts, join):
    out = jaccard.similar_sets(docs(spark, list(enumerate(texts))).repartition(4), join=join)
    return {r["doc_id"]: r["component_id"] for r in out.select("doc_id", "component_id").collect()}


def wanted(texts):
    sets = [plain_set(t) for t in texts]
    rows = list(enumerate(texts))
    group = plain_components(rows, lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    return {i: least[g] for (i, _), g in zip(rows, group)}


@pytest.mark.parametrize("short", [2, 16])
def test_copies_around_the_threshold_equal_all_pairs(spark, short):
    texts = variants(random.Random(5), 40, (1, 2, 3, 4, 5, 6))
    assert joined(spark, texts, jaccard.Join(cells=18, short=short)) == wanted(texts)


def test_copies_below_the_threshold_are_not_all_compared(spark, monkeypatch):
    texts = variants(random.Random(6), 24, (7,))
    seen, stored = {}, jaccard.stored

    def counted(df, name):
        out = stored(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    assert joined(spark, texts, jaccard.Join(cells=18, short=2)) == wanted(texts) == {i: i for i in range(24)}
    # all pairs are 276
    assert seen["hub_pairs"] + seen["set_pairs"] < 60


def test_lists_keep_what_a_pair_needs(spark):
    own = [(1, [1, 2, 3, 4, 5, 6, 7, 8]), (2, [1, 2, 3, 4, 5, 6, 7, 9]), (3, [1, 2, 3, 4, 20, 21, 22, 23])]
    rare = jaccard._rare_lists(spark.createDataFrame(own, "fp bigint, shingles array<bigint>"))
    members = rare.groupBy("key").agg(F.sort_array(F.collect_list("m.id")).alias("ids")).collect()
    # the third's own shingles fill its prefix; the first two have one each
    assert members and all(m["ids"] == [1, 2] for m in members)


def test_worker_keeps_the_chunks_in_use():
    coder = vocabulary.Encoder(public_tokenizers.path("byte_bpe_50k.json"), remembered=40)
    learn, learned = coder._learn, []
    coder._learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    plain = vocabulary.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(20):
        text = f"the house of words{i} a{i} b{i} c{i} d{i}".encode()
        assert coder.ids([text])[0].tolist() == plain.ids([text])[0].tolist()
        assert len(coder.seen) + len(coder.older) <= 40
    assert learned.count(b" house") == 1
