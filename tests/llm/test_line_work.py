"""Comparing of lines: form sets once per form, counts as by plain sets, and scratch that goes."""

import os

import pyarrow as pa

from simsift.llm import lines
from simsift.session import shared_dir

NEAR = lines.Near()


def _docs(spark):
    texts = [f"shared heading of all the pages here\nown line number {i} with words {i * i}\n" + " ".join(f"w{i}x{k}" for k in range(3 * i)) for i in range(40)]
    texts += [None, "", texts[3], texts[3]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"host{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_a_form_of_many_pairs_is_hashed_once(monkeypatch):
    forms = [f"a line of some words that differ by {i % 90} and no more {i % 90}" for i in range(300)] + ["aaaaaaaaaaaaaaaa", "12345678"]
    xs, ys = [forms[0]] * len(forms), forms
    hashed, sets = [], lines.form_sets
    monkeypatch.setattr(lines, "form_sets", lambda f, near: (hashed.extend(f), sets(f, near))[1])
    got = list(lines._overlaps(pa.array(xs), pa.array(ys), NEAR))
    assert sorted(hashed) == sorted(set(forms))
    x, all_ = lines.form_shingles(forms[0], NEAR.width), [lines.form_shingles(y, NEAR.width) for y in ys]
    assert got == [(len(x & y), len(x | y)) for y in all_]


def test_runs_of_pairs_are_cut_by_their_characters(monkeypatch):
    monkeypatch.setattr(lines, "COMPARED", 100)
    forms = [f"{i} of the forms, " * (1 + i % 9) for i in range(60)]
    xs, ys = forms[:-1], forms[1:]
    got = list(lines._overlaps(pa.array(xs), pa.array(ys), NEAR))
    pairs = [(lines.form_shingles(x, NEAR.width), lines.form_shingles(y, NEAR.width)) for x, y in zip(xs, ys)]
    assert got == [(len(x & y), len(x | y)) for x, y in pairs]
    assert list(lines._overlaps(pa.array([], pa.string()), pa.array([], pa.string()), NEAR)) == []


def test_line_dedup_leaves_no_scratch_but_its_result(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    got = lines.without_repeats(_docs(spark))
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert [name.split("-")[0] for name in left] == ["dropped"]
    assert got.filter("lines.dropped > 0").count() > 30
