"""Native operators against plain Python, on small tables with odd rows."""

import datetime
import hashlib
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from simsift.llm import decontaminate, feistel, hostrules, pseudonyms, queries, shards, toolcalls, urllists
from simsift.session import stored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, w int, shard string"
PROSE = "one two three four five six seven eight nine ten " * 12


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "h", 0, "mine", 7, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids and columns with clashing names."""
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "r", 1, "s"),
        (3, "x y z " * 60_000, "en", "a", 0, "r", 1, "s"), (3, "x y z " * 60_000, "en", "a", 0, "r", 1, "s"),
        (4, PROSE, "de", None, 0, "r", 1, "s"), (None, PROSE, "de", "b", 0, "r", 1, "s"),
        (5, "a\n\n a \nb\na", "en", "b", 0, "r", 1, "s"),
    ]
    return spark.createDataFrame(rows, DOCS)


# --- host rules


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_python(spark, odd):
    got = hostrules.measures(odd).select("row.text", "m.*").collect()
    for r in got:
        n = plain_measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert len(got) == 7


def test_host_is_rejected_on_evidence_only(spark):
    good = " ".join(f"w{i}" for i in range(80))
    texts = ["short"] * 80 + [good] * 20 + [good] * 400 + ["short"]
    hosts = ["bad"] * 100 + [f"h{i % 20}" for i in range(400)] + ["tiny"]
    measured = hostrules.measures(docs(spark, texts, hosts))
    verdicts = stored(hostrules.host_verdicts(hostrules.host_counts(measured)), "hosts")
    out = {r["host"]: r for r in verdicts.collect()}
    assert [h for h, r in out.items() if r["rejected"]] == ["bad"]
    assert out["tiny"]["short_rate"] < 1.0  # drawn to the mean of all
    kept = hostrules.with_verdict(measured, verdicts).groupBy("host").agg(F.count_if("kept").alias("n")).collect()
    assert {r["host"]: r["n"] for r in kept}["bad"] == 0 and sum(r["n"] for r in kept) == 400


def test_host_rules_on_an_empty_table(spark, odd):
    measured = hostrules.measures(odd.limit(0))
    verdicts = stored(hostrules.host_verdicts(hostrules.host_counts(measured)), "hosts")
    assert hostrules.with_verdict(measured, verdicts).count() == 0


# --- URL lists


def plain_verdict(url, day, entries):
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#]*)(?:/([^/?#]*))?", url or "")
    host = re.sub(r":\d*$|\.$", "", m[1].split("@")[-1]).lower() if m else ""
    if not host or day is None:
        return set()
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | ({f"{host}/{m[2]}"} if m[2] else set())
    out = set()
    for key, cat in {(e[1].lower(), e[2]) for e in entries if None not in e and e[1].lower() in keys}:
        past = [(e[4], e[0], e[3]) for e in entries if None not in e and (e[1].lower(), e[2]) == (key, cat) and e[4] <= day]
        if past and max(past)[2] == "add":
            out.add(cat)
    return out


def test_url_verdicts_equal_plain_python(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [
        ("e1", "Bad.com", "ads", "add", day(5)), ("e2", "bad.com", "ads", "remove", day(40)),
        ("e3", "bad.com", "ads", "add", day(40)), ("e4", "bad.com", "ads", "remove", day(95)),
        ("e5", "www.ok.org/shop", "adult", "add", day(10)), ("e6", "ok.org", "x", "remove", day(1)),
        ("e7", "org", "tld", "add", day(200)), ("e8", None, "x", "add", day(1)), ("e9", "q.com", "x", "add", None),
    ]
    urls = ["http://bad.com/", "https://u@a.bad.com:80/x", "http://notbad.com", "http://www.ok.org/shop/1?q",
            "http://www.ok.org/", "nonsense", None, "http://BAD.com."]
    rows = [(u, day(n) if n >= 0 else None, "mine", "h") for u in urls for n in (-1, 0, 5, 39, 40, 94, 95, 100, 210)]
    rows += rows[:30]
    captures = spark.createDataFrame(rows, "url string, fetched_on date, host string, verdict string")
    lists = spark.createDataFrame(
        entries, "entry_id string, pattern string, category string, action string, day date"
    )
    got = urllists.judged(captures, lists).select("row.url", "row.fetched_on", "row.verdict", "verdict.blocked", "verdict.categories").collect()
    assert len(got) == len(rows)
    for url, on, own, blocked, categories in got:
        want = plain_verdict(url, on, entries)
        assert (set(categories), blocked, own) == (want, bool(want), "h"), (url, on)
    assert any(r["blocked"] for r in got)
    assert urllists.judged(captures.limit(0), lists).count() == 0
    assert not any(r["verdict"]["blocked"] for r in urllists.judged(captures, lists.limit(0)).collect())


# --- Feistel, shards


def plain_feistel(x, a, b, key, rounds=6):
    left, right = divmod(x, b)
    mixed = lambda i, v, n: int(hashlib.md5(f"{key}:{i}:{v}".encode()).hexdigest()[:15], 16) % n
    for i in range(1, rounds + 1):
        if i % 2:
            left = (left + mixed(i, right, a)) % a
        else:
            right = (right + mixed(i, left, b)) % b
    return left * b + right


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_permute_is_the_walked_network(spark, n):
    a, b = feistel.halves(n)
    assert a * b >= n and a * b - n < max(a, 2)
    rows = spark.range(n).select("id", feistel.permute(F.col("id"), n, "k").alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    for r in rows:
        x = plain_feistel(r["id"], a, b, "k")
        while x >= n:
            x = plain_feistel(x, a, b, "k")
        assert r["p"] == x


def test_shards_are_even_gapless_and_reproducible(spark, odd):
    many = odd.unionByName(docs(spark, [f"t{i}" for i in range(90)])).unionByName(docs(spark, ["same"] * 1).crossJoin(spark.range(500)).drop("id"))
    out = shards.shuffle_into_shards(many, ["doc_id", "text"], 8, "seed").collect()
    again = shards.shuffle_into_shards(many.repartition(3), ["doc_id", "text"], 8, "seed").collect()
    key = lambda r: (r["doc_id"], r["text"], r["shard"], r["slot"])
    assert sorted(map(str, map(key, out))) == sorted(map(str, map(key, again)))
    counts = {}
    for r in out:
        counts.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in counts.values()]
    assert sum(sizes) == 597 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    ranks = {r["id"]: r["n"] for r in shards.number_rows(spark.range(50).withColumn("x", -F.col("id")), ["x"], "n")[0].collect()}
    assert ranks == {i: 49 - i for i in range(50)}
    assert shards.shuffle_into_shards(many.limit(0), ["doc_id"]).count() == 0


def test_sharding_query(spark):
    rows = queries.QUERIES["op10_sharding"].run(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts)
    n = len(order)
    a, b = feistel.halves(n)
    number = {d: i for i, d in enumerate(order)}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
        x = plain_feistel(number[r["doc_id"]], a, b, "shards")
        while x >= n:
            x = plain_feistel(x, a, b, "shards")
        assert (r["shard"], r["slot"]) == (x % 8, x // 8)
    assert len(rows) == n


# --- pseudonyms


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark, odd):
    values = {
        "card": ["4539578763621486", "4539 5787 6362 1486", "5500-0000-0000-0004"],
        "ip": ["10.0.0.1", "255.255.255.0"], "date": ["2024-02-29", "31.12.1999", "01/02/2003"],
        "ssn": ["123-45-6789", "665-01-0001"], "phone": ["+1 (988) 555-2485"], "email": ["ann.b9@mail1.example.com"],
        "secret": ['token = "1beb58b8af68854f"', "password=b7db7aa4a5"], "iban": ["DE89 3704 0044 0532 0130 00"],
    }
    plain = ["4539578763621487", "999.1.1.1", "2023-02-29", "000-12-3456", "v1.2.3", "DE00370400440532013000"]
    texts = [f"see {v} here" for vs in values.values() for v in vs] + [f"see {v} here" for v in plain]
    out = pseudonyms.pseudonymise(docs(spark, texts + texts), "k").select("row.*", "found").orderBy("doc_id").collect()
    kinds = [k for k, vs in values.items() for _ in vs] + [None] * len(plain)
    half = len(texts)
    for i, (kind, before) in enumerate(zip(kinds, texts)):
        after, found = out[i]["text"], out[i]["found"]
        assert after == out[i + half]["text"]  # linked
        if kind is None:
            assert after == before and not found, before
            continue
        assert [f["kind"] for f in found] == [kind] and after != before, (before, found)
        shape = lambda s: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        new, old = found[0]["pseudonym"], found[0]["value"]
        if kind != "ip":
            assert shape(new) == shape(old)
        assert after == before.replace(old, new) and out[i]["row"] == "mine"
        if kind == "card":
            assert luhn(new)
        elif kind == "ip":
            assert all(0 <= int(o) <= 255 for o in new.split("."))
        elif kind == "date" and "-" in new:
            datetime.date.fromisoformat(new)
        elif kind == "iban":
            s = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    digits = lambda i: re.sub(r"\D", "", out[i]["found"][0]["pseudonym"])
    assert digits(0) == digits(1)  # one card, written in two ways
    assert pseudonyms.pseudonymise(odd, "k").filter("size(found) > 0").count() == 0
    assert pseudonyms.pseudonymise(odd.limit(0), "k").count() == 0
    assert [r["t"] for r in pseudonyms.pseudonymise(odd, "k").filter("row.doc_id = 1").select(F.col("row.text").alias("t")).collect()] == [None]


def test_string_permutation_is_one_to_one(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    out = rows.select(pseudonyms.permute_string(F.col("s"), "k").alias("p")).collect()
    assert sorted(r["p"] for r in out) == [f"{i:03d}" for i in range(1000)]


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(146097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    got = days.select(pseudonyms.date(F.col("d"), "k").alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(got) == (146097, "1800-01-01", "2199-12-31")


# --- tool calls


def test_tool_calls(spark):
    schemas = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {}}
    calls = [
        ("c", "1", "f", '{"b": "x", "a": 1}', []), ("c", "2", "f", '{"a": 1.5}', ["1"]), ("c", "3", "f", "{", ["1", "2"]),
        ("c", "4", "g", "{}", ["5"]), ("c", "5", "g", "{}", ["4"]), ("c", "6", "g", '{"z": [1, {"b": 1, "a": null}]}', ["3", "none"]),
        ("d", "1", "h", "{}", None), ("c", "1", "f", '{"b": "x", "a": 1}', []), (None, "1", "g", "{}", []), ("d", "2", "g", None, []),
        ("c", "7", "g", "{}", ["4"]),
    ]
    results = [("c", "1", "r"), ("c", "1", "q"), ("c", "4", None), (None, "1", "lost"), ("c", "6", "s")]
    frame = spark.createDataFrame(calls, "conv_id string, call_id string, tool string, arguments string, depends_on array<string>")
    answers = spark.createDataFrame(results, "conv_id string, call_id string, content string")
    rows = toolcalls.linked(frame.withColumn("level", F.lit("own")), answers, schemas).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(rows) == len(calls)
    level = {k: r["level"] for k, r in got.items()}
    assert level == {("c", "1"): 0, ("c", "2"): 1, ("c", "3"): 2, ("c", "4"): None, ("c", "5"): None, ("c", "6"): 3,
                     ("c", "7"): None, ("d", "1"): 0, ("d", "2"): 0, (None, "1"): None}
    assert got["c", "2"]["errors"] == ["type:a"] and got["c", "3"]["errors"] == ["json"] and got["d", "1"]["errors"] == ["tool"]
    assert got["c", "6"]["errors"] == ["unknown:z"] and got["d", "2"]["errors"] == ["json"]
    assert got["c", "1"]["status"] == "ok" and got["c", "1"]["n_results"] == 2
    assert got["c", "4"]["status"] == "cycle" and got["c", "5"]["status"] == "unlinked" and got[None, "1"]["status"] == "unlinked"
    assert got["c", "1"]["record"] == '{"arguments":{"a":1,"b":"x"},"id":"1","name":"f","result":"q"}'
    assert json.loads(got["c", "6"]["record"])["arguments"] == {"z": [1, {"a": None, "b": 1}]}
    assert toolcalls.linked(frame.limit(0), answers, schemas).count() == 0


# --- decontamination


def plain_contained(text, item):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    q = [x for x in re.split(r"[\W_]+", (item or "").lower()) if x]
    if not q:
        return False
    k = min(5, len(q))
    grams = lambda v: {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
    return 100 * len(grams(q) & grams(w)) >= 75 * len(grams(q))


def test_contained_items_equal_brute_force(spark, odd):
    words = [f"w{i}" for i in range(3000)]
    items = [(1, " ".join(words[100:140])), (2, "Three four!"), (3, None), (4, ""), (5, " ".join(words[500:560])),
             (6, "solo"), (7, " ".join(words[2000:2017])), (7, "one two three four five six")]
    cut = words[:]
    cut[520] = "changed"
    texts = [" ".join(words), " ".join(cut), " ".join(words[100:130]), " ".join(words[100:133]), "SOLO, and three; four", "w1"]
    table = docs(spark, texts).unionByName(odd)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(table, bench).collect()}
    want = {(d["doc_id"], i) for d in table.collect() for i, t in items if plain_contained(d["text"], t)}
    assert got == want and (1, 5) in got and (2, 1) not in got
    kept = decontaminate.without_items(table, bench)
    assert kept.columns == table.columns
    clean = [d for d in table.collect() if not any(plain_contained(d["text"], t) for _, t in items)]
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean))
    assert decontaminate.without_items(table, bench.limit(0)).count() == table.count()
    assert decontaminate.contained(table.limit(0), bench).count() == 0
