"""Quality rules: texts measured once in the pipeline, and the measures against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from simsift.llm import hostrules


def _docs(spark):
    texts = [f"shared heading of all the pages here\nown line number {i} with words {i * i}\n" + " ".join(f"w{i}x{k}" for k in range(3 * i)) for i in range(40)]
    texts += [None, "", texts[3], texts[3]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"host{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_rules_read_texts_once(spark):
    docs = _docs(spark)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert "doc_id" in kept.columns and "split(" not in kept._jdf.queryExecution().optimizedPlan().toString()
    measured = hostrules.measures(docs)
    verdicts = hostrules.host_verdicts(hostrules.host_counts(measured))
    plain = hostrules.with_verdict(measured, verdicts).filter("kept").select("row.*")
    assert kept.columns == docs.columns and 0 < plain.count() < docs.count()
    assert kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()


def test_repeated_words_against_plain_python(spark):
    texts = ["a b c d a b c", "x " * 30, "a b c", "a b", "", None, "a b c x a b c y a b c x a b", "one two three four five six"]

    def plain(text):
        w = (text or "").split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})

    rows = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = hostrules.measures(rows).select("row.doc_id", "m.n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_symbols_of_texts(spark):
    rows = spark.createDataFrame([("a#b*$%&|<>",), ("é<ü>",), ("none",), ("",)], "t string")
    assert [r[0] for r in rows.select(hostrules._symbols(F.col("t"))).collect()] == [8, 2, 0, 0]
