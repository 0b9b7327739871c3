"""Line dedup: all pairs that meet in a band count, whichever form is a band's least."""

import random
from itertools import combinations

import pytest

from simsift.llm import lines

from test_other_ops import docs, plain_components


def banded_groups(forms, near):
    """Number of components by all pairs that share a band and are similar."""
    keys = lines.band_keys(forms, near)
    sets = [lines.form_shingles(f, near.width) for f in forms]
    met = set()
    for band in range(near.bands):
        at = {}
        for i, k in enumerate(keys[:, band].tolist()):
            at.setdefault(k, []).append(i)
        for own in at.values():
            met.update(combinations(own, 2))
    near_by = {(i, j) for i, j in met if 100 * len(sets[i] & sets[j]) >= near.percent * len(sets[i] | sets[j])}
    return len(set(plain_components(forms, lambda i, j: (i, j) in near_by)))


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))


def star(rng):
    """Variants of one line, each one word off it, that are rarely similar to each other."""
    base = [word(rng) for _ in range(14)]
    out = []
    for _ in range(400):
        own = base[:]
        own[rng.randrange(14)] = word(rng)
        out.append(" ".join(own))
    return out


def tailed(rng):
    """Pairs of similar lines whose tail all pairs have in common."""
    tail, out = " ".join(word(rng) for _ in range(7)), []
    for _ in range(100):
        head = [word(rng) for _ in range(7)]
        out.append(" ".join([*head, tail]))
        head[rng.randrange(7)] = word(rng)
        out.append(" ".join([*head, tail]))
    return out


@pytest.mark.parametrize("family,tasks", [(star, 1), (star, 8), (tailed, 8)])
def test_families_around_a_band_equal_brute_force(spark, family, tasks):
    forms = sorted(set(family(random.Random(11))))
    frame = docs(spark, list(enumerate(forms))).repartition(tasks)
    got = lines.without_repeats(frame).select("row.text").collect()
    assert sum(r["text"] != "" for r in got) == banded_groups(forms, lines.Near())


def test_short_lines_count_too(spark):
    rows = [
        (1, "All rights reserved.\nx\n\n---"), (2, "x\nall  rights reserved.\n\nown text"),
        (3, "xy\nAll rights reserved!\n---\n "), (4, "seven77\nseven78\nseven77"),
    ]
    got = lines.without_repeats(docs(spark, rows).repartition(3)).select("row.doc_id", "row.text", "lines.dropped").collect()
    # the third is one shingle of 13 off the first: 12 / 14
    want = [(1, rows[0][1], 0), (2, "\nown text", 2), (3, "xy\n ", 2), (4, "seven77\nseven78", 1)]
    assert sorted((r["doc_id"], r["text"], r["dropped"]) for r in got) == want
