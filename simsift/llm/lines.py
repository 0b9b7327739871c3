"""Removal of repeated lines, equal or nearly so, across all documents.

A line counts by its normal form (lower case, runs of white space as one space); empty forms are left
alone. Two forms are near when the Jaccard similarity of their sets of 8-character shingles is
0.75 or more. A shorter form is its own and only shingle, so it is near to equal ones alone.

1. Signatures. One-permutation MinHash: a shingle's hash falls into one of 48 bins, the least of
   each bin counts, empty bins take their neighbour's. 12 bands of 4: of two forms with similarity
   s, 1 - (1 - s**4)**12 meet in a band: 99 % at 0.75, 99.9 % at 0.82.
2. First candidates. Forms of a band are paired with its least form and with the next.
3. Verification by the exact Jaccard similarity of the shingle sets, a shingle being named by 64 bits.
4. Components of the verified pairs (distributed union-find by labels).
5. A band that still holds several components is open. A component's hub is its least form. Hubs that meet
   in an open band are compared; as Jaccard distance is a metric, hubs that lie far apart rule out pairs of
   their forms, and the pairs of a band that they do not rule out are compared too. So all forms that meet in a
   band are compared, ruled out or of one component.
6. A component and all its occurrences keep the first line, by (doc_id, line number); every other is dropped.

Between the steps travel 64-bit hashes of the forms; texts only of forms with a candidate.

Rows with equal doc_id and text are one document and get the same text. A null text stays null.
A document whose lines all stand elsewhere first keeps its row, with an empty text. Null doc_ids come
first. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled, stored
from . import buckets
from .graph import components


@dataclass(frozen=True)
class Near:
    shortest: int = 1
    width: int = 8
    percent: int = 75
    bands: int = 12
    rows: int = 4
    seed: int = 7


def normal_lines(text: Column) -> Column:
    """Normal forms of a text's lines, but for white space at their ends.

    Plain substring searches spare most texts the pattern.
    """
    other = F.lit(False)
    for space in ("  ", "\t", "\r", "\f", "\x0b"):
        other = other | F.contains(text, F.lit(space))
    single = F.when(other, F.regexp_replace(text, r"[^\S\n]{2,}|[\t\x0B\f\r]", " ")).otherwise(text)
    return F.split(F.lower(single), "\n", -1)


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def line_table(docs: DataFrame, doc_id: str, text: str, near: Near) -> DataFrame:
    """(key, doc_id, line, h, form): the lines that count; h names the form."""
    split = docs.select(
        row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"),
        F.posexplode(normal_lines(F.col(text))).alias("line", "raw"),
    )
    formed = split.select("key", "doc_id", "line", F.trim("raw").alias("form"))
    return formed.filter(F.length("form") >= near.shortest).withColumn("h", F.xxhash64("form"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(points: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of the shingle that starts at each place; the last width - 1 places are not valid."""
    base = (0xD1342543DE82EF95 + 2 * seed) % 2**64
    out, have = points.copy(), 1  # hash of the first ``have`` characters
    while have < width:
        more = min(have, width - have)
        # polynomial of have + more characters, from two overlapping ones where width is no power of two
        tail = out[more:].copy()
        if more < have:
            out[: len(out) - more] = out[: len(out) - more] * np.uint64(pow(base, have + more, 2**64)) + tail
        else:
            out *= np.uint64(pow(base, more, 2**64))
            out[: len(tail)] += tail
        have += more
    return _mixed(out)


def band_keys(forms: list[str], near: Near) -> np.ndarray:
    """forms x bands, int64; every form has ``width`` characters at least."""
    bins = near.bands * near.rows
    points = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(f) for f in forms])
    hashed = shingle_hashes(points, near.width, near.seed)
    # the last width - 1 places of a form start no shingle
    valid = np.ones(len(points), dtype=bool)
    valid[(np.cumsum(lengths)[:, None] - np.arange(1, near.width)).reshape(-1)] = False
    hashed, owner = hashed[valid], np.repeat(np.arange(len(forms)), lengths - near.width + 1)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(forms) * bins, empty, dtype=np.uint64)
    bin_of = ((hashed >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    np.minimum.at(least, owner * bins + bin_of, hashed)
    least = least.reshape(len(forms), bins)
    # an empty bin takes the next full one to its right, moved by the distance
    sparse = np.flatnonzero((least == empty).any(axis=1))
    some = least[sparse]
    while (gap := some == empty).any():
        right = np.roll(some, -1, axis=1)
        some = np.where(gap & (right != empty), right * np.uint64(3) + np.uint64(1), some)
    least[sparse] = some
    out = np.empty((len(forms), near.bands), dtype=np.uint64)
    for band in range(near.bands):
        key = np.full(len(forms), band + 1, dtype=np.uint64)
        for row in range(near.rows):
            key = _mixed(key * np.uint64(0x2545F4914F6CDD1D) + least[:, band * near.rows + row])
        out[:, band] = key
    return out.view(np.int64)


def candidates(lines: DataFrame, near: Near) -> DataFrame:
    """Meetings of forms in a band, by their hashes."""
    n_buckets = buckets.bucket_count(lines)

    def run(batches):
        keys, members, seen = [], [], set()
        for batch in batches:
            own = {}
            for h, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in seen:
                    own[h] = form
            if own:
                seen.update(own)
                made = band_keys(list(own.values()), near)
                keys.append(made.reshape(-1))
                members.append(np.repeat(np.fromiter(own, dtype=np.int64, count=len(own)), near.bands))
        if keys:
            yield from buckets.entries(
                np.concatenate(keys), np.concatenate(members), n_buckets, TaskContext.get().partitionId()
            )

    # shorter forms are near to equal ones alone, which have one h
    long = lines.select("h", "form").filter(F.length("form") >= near.width)
    return buckets.meetings(long.mapInArrow(run, buckets.ENTRIES))


def form_shingles(form: str, width: int) -> set[str]:
    return {form[i : i + width] for i in range(max(1, len(form) - width + 1))}


def form_sets(forms: list[str], near: Near) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every form's shingles."""
    points = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    hashed, out, end = shingle_hashes(points, near.width, near.seed), [], 0
    for form in forms:
        end += len(form)
        own = hashed[end - len(form) : end - near.width + 1]
        own.sort()  # in place: no two forms share a place
        new = own[1:] != own[:-1]
        out.append(own if new.all() else np.append(own[:1], own[1:][new]))
    return out


#: Characters whose shingles a comparing worker hashes at once, 8 bytes each; a longer form is alone.
COMPARED = 1 << 20


def _overlaps(x: pa.Array, y: pa.Array, near: Near) -> Iterator[tuple[int, int]]:
    """(shingles in both, in either) of the forms of every pair.

    A form that stands in many pairs is hashed and sorted once for each run of pairs: hubs meet many forms.
    """
    named = pa.concat_arrays([x, y]).dictionary_encode()
    forms, index = named.dictionary.to_pylist(), named.indices.to_numpy()
    left, right, sizes = index[: len(x)].tolist(), index[len(x) :].tolist(), list(map(len, forms))
    low = 0
    while low < len(left):
        own, size, high = {}, 0, low
        while high < len(left):
            fresh = {k for k in (left[high], right[high]) if k not in own}
            size += sum(sizes[k] for k in fresh)
            if size > COMPARED and high > low:
                break
            own.update(dict.fromkeys(sorted(fresh)))
            high += 1
        own.update(zip(own, form_sets([forms[k] for k in own], near)))
        for a, b in zip(left[low:high], right[low:high]):
            a, b = own[a], own[b]
            all_ = np.concatenate((a, b))
            all_.sort(kind="stable")  # merges the two runs
            both = int(np.count_nonzero(all_[1:] == all_[:-1]))
            yield both, len(all_) - both
        low = high


def compared(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(pairs' columns, distance, linked): exact Jaccard distance of a and b, and whether it is within the threshold."""
    names = pairs.columns
    met = pairs.join(texts.select(F.col("h").alias("b"), F.col("form").alias("y")), "b").join(
        texts.select(F.col("h").alias("a"), F.col("form").alias("x")), "a"
    )

    def run(batches):
        for batch in batches:
            counts = list(_overlaps(batch.column(len(names)), batch.column(len(names) + 1), near))
            both, either = np.array(counts, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(1 - both / either), pa.array(100 * both >= near.percent * either)],
                names=[*names, "distance", "linked"],
            )

    schema = ", ".join([f"{n} bigint" for n in names] + ["distance double", "linked boolean"])
    return met.select(*names, "x", "y").mapInArrow(run, schema)


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, h, hub): the forms of bands that hold several components."""
    named = stored(
        members.join(groups, F.col("h") == F.col("node"), "left").select(
            "key", "h", F.coalesce("component", "h").alias("hub")
        ),
        "band_members",
    )
    # minima are combined before the shuffle
    several = named.groupBy("key").agg(F.min("hub").alias("x"), F.max("hub").alias("y")).filter("x < y").select("key")
    return stored(named.join(stored(several, "open_bands"), "key", "left_semi").distinct(), "open_members")


def _between_hubs(members: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(a, b): hubs whose components link through forms that meet in a band; members: (key, h, hub)."""
    apart = 1 - near.percent / 100 + 1e-9
    hubs = stored(members.select("key", "hub").distinct(), "open_hubs")
    met = hubs.select("key", F.col("hub").alias("a")).join(hubs.select("key", F.col("hub").alias("b")), "key")
    hub_pairs = stored(met.filter("a < b").select("a", "b").distinct(), "hub_pairs")
    between = stored(compared(hub_pairs, texts, near), "hub_distances")
    links = between.filter("linked").select("a", "b")
    spokes = stored(
        members.filter("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct(), "spokes"
    )
    away = stored(
        compared(spokes, texts, near).select(F.col("b").alias("h"), F.col("a").alias("hub"), F.col("distance").alias("away")),
        "away",
    )
    farthest = away.groupBy("hub").agg(F.max("away").alias("far"))
    linked = stored(components(links), "hub_groups")
    for side in ("a", "b"):
        between = between.join(
            linked.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left"
        ).join(farthest.select(F.col("hub").alias(side), F.col("far").alias(f"far_{side}")), side, "left")
    undecided = stored(
        between.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .filter(F.coalesce("far_a", "far_b").isNotNull())  # two single forms: compared just now
        .filter(F.col("distance") - F.coalesce("far_a", F.lit(0.0)) - F.coalesce("far_b", F.lit(0.0)) <= apart)
        .select("a", "b", "distance"),
        "near_hubs",
    )
    if undecided.isEmpty():
        return links
    placed = stored(
        members.join(away, ["h", "hub"], "left").select("key", "h", "hub", F.coalesce("away", F.lit(0.0)).alias("away")),
        "placed",
    )
    x = placed.select("key", F.col("hub").alias("a"), F.col("h").alias("x"), F.col("away").alias("dx"))
    y = placed.select("key", F.col("hub").alias("b"), F.col("h").alias("y"), F.col("away").alias("dy"))
    rest = (
        x.join(undecided, "a").join(y, ["key", "b"]).filter(F.col("distance") - F.col("dx") - F.col("dy") <= apart)
        .filter("x <> a OR y <> b")
        .select(F.col("a").alias("hub_a"), F.col("b").alias("hub_b"), F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )
    more = compared(stored(rest, "form_pairs"), texts, near).filter("linked")
    return links.unionByName(stored(more.select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b")), "form_links"))


def line_groups(lines: DataFrame, near: Near) -> DataFrame:
    """(node, component) of the forms that link with another, by all pairs that meet in a band."""
    met = stored(candidates(lines, near), "line_meetings")
    pairs = stored(met.filter("pairs").select("a", "b").distinct(), "line_pairs")
    # whoever meets another in a band is in a pair
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "line_ends")
    # one text per form: its hash names it
    texts = stored(lines.select("h", "form").join(ends, "h", "left_semi").dropDuplicates(["h"]), "line_texts")
    links = compared(pairs, texts, near).filter("linked").select("a", "b")
    groups = stored(components(links), "line_groups")
    members = _open_members(met.filter("NOT pairs").select(F.col("a").alias("key"), F.col("b").alias("h")), groups)
    if members.isEmpty():
        return groups
    # components of hubs: a hub is its component's least form, so the least hub is the least form of all
    joined = stored(components(_between_hubs(members, texts, near)), "joined_hubs")
    of = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = joined.join(groups, "node", "left_anti")
    whole = groups.join(of, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return stored(whole.unionByName(alone), "line_groups")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """(key, lines): per document the numbers of the lines that stand elsewhere before."""
    lines = line_table(docs, doc_id, text, near)
    groups = line_groups(lines, near)
    place = F.struct("doc_id", "key", "line")
    seen = stored(lines.select("h", place.alias("at")), "lines")
    # first occurrence and number per form, then per component
    forms = stored(seen.groupBy("h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "forms")
    named = forms.join(groups, F.col("h") == F.col("node"), "left").select(
        "h", "first", "n", F.coalesce("component", "h").alias("g")
    )
    kept = named.groupBy("g").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).filter("all > 1")
    keepers = stored(named.join(kept.select("g", "keep"), "g").select("h", "keep"), "keepers")
    out = seen.join(keepers, "h").filter(~F.col("at").eqNullSafe(F.col("keep")))
    return out.groupBy(F.col("at.key").alias("key")).agg(F.collect_set("at.line").alias("lines"))


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: Near = Near()
) -> DataFrame:
    """(row, lines) per document: its columns with the text less repeated lines, and struct (n, dropped)."""
    gone = settled(lambda: dropped_lines(docs, doc_id, text, near), "dropped").withColumnRenamed("lines", "gone")
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("key"), F.col(text).alias("t"))
    split = F.split("t", "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("gone", i)), "\n")
    return rows.join(gone, "key", "left").select(
        F.col("row").withField(f"`{text}`", F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept)).alias("row"),
        F.struct(
            F.coalesce(F.size(split), F.lit(0)).alias("n"), F.coalesce(F.size("gone"), F.lit(0)).alias("dropped")
        ).alias("lines"),
    )
