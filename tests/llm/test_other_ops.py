"""Packing, language, set join, line dedup and the pipeline against brute force."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simsift.llm import hostrules, jaccard, langid, lines, packing, queries, shingles
from simsift.session import stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key string, row int"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "h", len(t or ""), "f", "k", 1) for i, t in rows], DOCS)


# --- packing


def reference_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(pieces, ids, window):
    """Every id in one piece, sequences gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(own)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for r in sorted(ps, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    for ps in by_seq.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    used = sum(r["length"] for r in pieces)
    return len(by_seq) * window / used - 1


def test_packing_query_round_trip(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = dict(zip([r["doc_id"] for r in table], reference_ids([r["text"] for r in table])))
    pieces = queries.QUERIES["op1_packing"].run(spark, SF).collect()
    assert check_pieces(pieces, ids, 2048) < 0.03


def test_packing_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a" * 30_000), (4, "a<|endoftext|>b <|endoftext|> é日\x00\n\n. "), (5, "word " * 400_000), (6, "tail.")]
    for block in (64, 1 << 21):
        p = packing.public_packing(window=64, block=block)
        pieces = packing.pack(docs(spark, rows).coalesce(1), p).collect()
        check_pieces(pieces, dict(zip([i for i, _ in rows], reference_ids([t for _, t in rows]))), 64)
    assert packing.pack(docs(spark, rows).limit(0), p).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_no_more_than_any_others(seed):
    rng = random.Random(seed)
    window, n = rng.choice([3, 8, 20]), rng.randint(1, 60)
    at = sorted(rng.sample(range(1, n + 1), rng.randint(1, n)) + [n])
    at = np.unique([*at, *range(window, n, window)])
    penalty = np.array([rng.choice([0, 2, 9]) for _ in at])
    cost = {0: 0}
    for j, pen in zip(at.tolist(), penalty.tolist()):
        cost[j] = min((cost[i] + window - (j - i) + pen for i in cost if j - i <= window), default=None)
        if cost[j] is None:
            del cost[j]
    if n not in cost or len(cost) != len(at) + 1:
        return
    cuts = packing.best_cuts(at, penalty, window)
    of = dict(zip(at.tolist(), penalty.tolist()))
    total = sum(window - (b - a) + of[b] for a, b in zip([0, *cuts], cuts))
    assert cuts[-1] == n and all(b - a <= window for a, b in zip([0, *cuts], cuts)) and total == cost[n]


# --- language


def test_language_of_held_out_documents(spark):
    out = queries.QUERIES["op2_language"].run(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_presence_kernel_equals_sets(spark):
    texts = ["Abc abd", "abc", "", "zzz zz一", "a" * 300 + "b"]
    known = langid.alphabet(texts, 4)
    symbol = {int(c): k + 2 for k, c in enumerate(known)}

    def grams(t):
        s = [symbol.get(ord(c), 1) if c.isalpha() else 0 for c in t.lower()] + [0]
        return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    g = langid.Grams(known)
    vocabulary = np.unique(np.concatenate([c for t in texts[:2] for _, c in g.of(g.symbol[langid.code_points([t])])]))
    held = grams(texts[0]) | grams(texts[1])
    for positions in (4, 1 << 20):
        model = langid.Model(known, vocabulary, np.zeros((len(vocabulary), 1)), langid.Fit(positions=positions))
        assert model.presence(texts).sum(axis=1).tolist() == [len(grams(t) & held) for t in texts]


def test_language_of_odd_rows(spark):
    en, fr = "the cat and the hat with that", "les chats et les chapeaux avec ceux"
    rows = [(i, [en, fr][i % 2] + f" {i}", ["en", "fr"][i % 2]) for i in range(40)]
    odd = [(100, None, "en"), (101, "", "fr"), (102, "12 34", "en"), (None, en, "en"), (103, "THE HAT " * 200_000, None), (1, fr, "fr")]
    table = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("score", F.lit("own"))
    model = langid.fit_model(table, F.lit(True))
    got = {(r["doc_id"], r["lang"]): r for r in langid.classify(table, model).collect()}
    assert all(r["lang_pred"] == lang for (i, lang), r in got.items() if i is not None and i < 40)
    assert [got[k]["lang_pred"] for k in ((100, "en"), (101, "fr"), (102, "en"))] == ["und"] * 3
    assert got[103, None]["lang_pred"] == "en" and got[None, "en"]["lang_pred"] == "en" and got[100, "en"]["score"] == 0.0
    assert langid.classify(table.limit(0), model).count() == 0
    assert langid.fit_model(table, F.lit(False)) is None
    assert {r["lang_pred"] for r in langid.classify(table, None).collect()} == {"und"}


# --- set join


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain_components(rows, linked):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if linked(i, j):
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def families(seed, small):
    """Families of edited copies, exact copies, shared passages, small sets and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5])))
    passage = [word() for _ in range(12)]
    out = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([5, 6, 7, 8, 9, 10, 12, 14, 17, 20] if small else [40, 80, 150]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            own = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1])] = [word()] * rng.choice([0, 1, 1])
            if rng.random() < 0.3:
                own = passage + own
            out.append(rng.choice(["  ", " ", "\n"]).join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,small,spread", [(1, True, 5), (2, False, 5), (3, True, 0), (4, False, 0)])
def test_set_join_equals_all_pairs(spark, seed, small, spread):
    texts = families(seed, small) + [None, "", " \t", "a", "a", "A b", "a B c d", "x " * 30_000, "x " * 30_000]
    rows = list(enumerate(texts)) + [(3, texts[3])]  # a repeated row
    sets = [plain_set(t) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= 75 * len(sets[i] | sets[j])

    group = plain_components(rows, linked)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    want = sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group))
    frame = docs(spark, rows).repartition(4)
    out = jaccard.similar_sets(frame, join=jaccard.Join(cells=18, spread=spread, entries=500))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == want
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(least.values())


def test_set_join_of_nothing(spark):
    assert jaccard.similar_sets(docs(spark, [(1, "a b")]).limit(0)).count() == 0
    one = jaccard.similar_sets(docs(spark, [(None, "a b c d e f"), (None, None), (7, "q")])).collect()
    assert sorted((r["n_shingles"], r["component_id"] is None) for r in one) == [(0, True), (1, False), (2, True)]


def test_shingle_hashes_tell_words_apart():
    texts = ["a b c d e", "ab c d e", "a bc d e f", "a  b\tc d e", "A B C D E", "É b c d e", "é b c d e", "", "a", "aa", "a a"]
    got = list(shingles.sets(texts))
    plain = [plain_set(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        assert (set(got[i].tolist()) == set(got[j].tolist())) == (plain[i] == plain[j]), (texts[i], texts[j])


# --- lines


def plain_line_dedup(rows, near):
    forms = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            form = re.sub(r"\s+", " ", line).strip().lower()
            if len(form) >= near.shortest:
                forms.append((i, k, form))
    sets = [lines.form_shingles(f, near.width) for *_, f in forms]
    group = plain_components(forms, lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    first = {}
    for (i, k, _), g in zip(forms, group):
        first[g] = min((i, k), first.get(g, (i, k)))
    gone = {(i, k) for (i, k, _), g in zip(forms, group) if first[g] != (i, k)}
    return {
        i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows
    }


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(7, 25)))
    base = [line() for _ in range(40)]

    def varied(s):
        w = s.split(" ")
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "edit"
        return rng.choice([" ", "  ", "\t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)

    rows = [(i, "\n".join([varied(rng.choice(base)) for _ in range(rng.randint(0, 6))] + ["short line", "short line"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, base[0] + "\r\n" + base[0]), (64, "z" * 50_000)]
    near = lines.Near()
    got = lines.without_repeats(docs(spark, rows).repartition(3)).select("row.*", "lines").collect()
    want = plain_line_dedup(rows, near)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert sum(r["lines"]["dropped"] for r in got) > 50 and all(r["key"] == "k" for r in got)
    assert lines.without_repeats(docs(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "a line that is long enough to be looked at by the operator"
    rows = [(1, text), (1, text), (2, text), (None, "x\n" + text)]
    got = lines.without_repeats(docs(spark, rows)).select("row.doc_id", "row.text").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "x\n" + text), (1, ""), (1, ""), (2, "")]


# --- pipeline


def test_pipeline_stages_equal_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    judged = queries.QUERIES["op3_host_rules"].run(spark, SF).collect()
    good = stored(stage["quality_rules"](spark, table, SF), "t")
    assert good.columns == table.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in judged if r["kept"]}
    assert sum(r["kept"] for r in judged) == sum(not r["base_failed"] for r in judged)

    lined = stored(stage["line_dedup"](spark, good, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    got = lined.collect()
    want = plain_line_dedup(rows, lines.Near())
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert lined.columns == table.columns and all(r["n_chars"] == len(r["text"]) for r in got)

    one = stored(stage["jaccard_join"](spark, lined, SF), "t")
    rows = sorted((r["doc_id"], r["text"]) for r in got)
    sets = [plain_set(t) for _, t in rows]
    group = plain_components(
        rows, lambda i, j: bool(sets[i] & sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    )
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    assert {r["doc_id"] for r in one.collect()} == set(least.values()) and one.columns == table.columns

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stored(stage["decontamination"](spark, one, SF), "t")

    def leaks(text, item):
        w, q = ([x for x in re.split(r"[\W_]+", s.lower()) if x] for s in (text, item))
        grams = lambda v: {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
        return 100 * len(grams(q) & grams(w)) >= 75 * len(grams(q))

    left = {r["doc_id"]: r["text"] for r in one.collect() if not any(leaks(r["text"], t) for t in items)}
    assert {r["doc_id"] for r in clean.collect()} == set(left)

    ids = dict(zip(left, reference_ids(list(left.values()))))
    check_pieces(stage["packing"](spark, clean, SF).collect(), ids, 2048)
    again = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in again} == {d: len(i) for d, i in ids.items()}
    assert hostrules.RULES == ("short", "repeats", "symbols")
