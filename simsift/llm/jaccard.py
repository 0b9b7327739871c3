"""Exact Jaccard join of documents on word shingles: size-aware, heavy and light sets.

Two documents link when 100 * |A & B| >= 75 * |A | B|. Result: a component per document.

1. One pass over the texts gives per document its set's size and fingerprint, and a count
   sketch of all shingles. Equal sets are one class from here on.
2. Shingles are put in a global order, rare before frequent, by their sketch cell. (The
   order decides about cost alone: any order that is the same for all sets finds all links.)
3. Keys. If |A & B| >= o, the first |A| - o + k shingles of A and the first |B| - o + k of B
   share k. Small sets (below the boundary) enumerate the subsets of size k = 2 of these; large sets
   post each of them to inverted lists, by which the lists' other sets are found, and count: k grows
   with the set, and what shares fewer lists is no candidate. Sets just below the boundary do both. The boundary is the size from which subsets cost more than
   scanning lists of the corpus' mean length, by the sketch.
4. Keys of one set alone are dropped. In a few turns each set is compared with one other, that
   among the heads of its lists with which it shares most lists; the pair is verified on the texts, and
   components are formed. So near copies cost a few comparisons each, however many there are.
5. A list that still holds several components is open. The sets of long open lists are dealt to new lists, one per
   shingle of their prefixes, with k = 1 and the order by exact counts among these sets: what a near copy alone
   has comes first, so the lists of what all copies share stay short. An entry says by its place in the order
   how large a set can be to which it may link. Sets that meet in short lists, or in a list's
   head, are compared first, and components are formed again.
6. In the short lists, and the new ones, that are still open each component has a hub, all its sets there a known distance to it. Hubs that
   meet in an open list are compared; as Jaccard distance is a metric, that rules out most pairs of their
   sets, and the pairs it does not rule out are compared too. So what is missing after the steps before is
   found here, and no pair is left out by a cap.

A key that is frequent by the sketch is spread over buckets by task. Between tasks travel
16 bytes per key and set; texts only of documents with a candidate. Classes are named by a
64-bit fingerprint.

A null or empty text has an empty set and links with nothing. Equal rows are one class. Null doc_ids
take part; a component of them alone has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import shingles
from .buckets import bucket_count
from .graph import components
from .tables import bucketed

_U = np.uint64
PERCENT = 75
ONE_LIST = 1 << 40  # of no set's size: sets below share one list at least, if they link


@dataclass(frozen=True)
class Join:
    """cells: of the sketch, 2**cells; chunk: of it, as it is sent; spread: sketch level from
    which a key is dealt to several buckets; entries: keys that a task holds before it sends them;
    turns: of comparing each set with one other, before all open pairs are compared; short: sets of a
    list whose pairs are all compared at once.
    """

    cells: int = 22
    spread: int = 5
    chunk: int = 1 << 18
    entries: int = 1 << 21
    turns: int = 2
    short: int = 16


def least_overlap(small: int, large: int) -> int:
    """Shingles that two sets of these sizes share at least, if they link."""
    total = PERCENT * (small + large)
    return -(-total // (100 + PERCENT))


def prefix_lengths(n: int, k: int) -> tuple[int, int]:
    """(as the smaller set, as the larger set): how many first shingles hold k shared ones."""
    smallest = -(-PERCENT * n // 100)
    return min(n, n - least_overlap(n, n) + k), min(n, n - least_overlap(smallest, n) + k)


def least_shared(n: int, edge: int) -> int:
    """k of a set: lists it shares with another of no less k, if they link. One for small sets."""
    return 1 if n < max(40, edge) else 1 + n // 25


def _least_shared(size: Column, edge: int) -> Column:
    return F.when(size < max(40, edge), 1).otherwise(1 + F.floor(size / 25))


# --- pass 1: sizes, fingerprints, sketch


def _summaries(docs: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """Rows (doc_id, n, fp, fp2, chunk, data): one per document, and the task's sketch in chunks."""
    size, shift = 1 << join.cells, _U(64 - join.cells)

    def run(batches):
        cells = np.zeros(size, dtype=np.uint32)
        pending, waiting = [], 0
        for batch in batches:
            n, fp, fp2 = [], [], []
            for own in shingles.sets(batch.column(1).to_pylist()):
                n.append(len(own))
                fp.append(int(shingles.mixed(own, 3).sum(dtype=np.uint64)))
                fp2.append(int(shingles.mixed(own, 5).sum(dtype=np.uint64)))
                pending.append(own)
                waiting += len(own)
                if waiting > size:
                    cells += np.bincount((np.concatenate(pending) >> shift).view(np.int64), minlength=size).astype(np.uint32)
                    pending, waiting = [], 0
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()),
                    pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(np.array(fp2, dtype=np.uint64).view(np.int64)),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                ],
                names=["doc_id", "n", "fp", "fp2", "chunk", "data"],
            )
        if pending:
            cells += np.bincount((np.concatenate(pending) >> shift).view(np.int64), minlength=size).astype(np.uint32)
        parts = [np.minimum(c, 255).astype(np.uint8) for c in cells.reshape(-1, join.chunk)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(parts), pa.int64())] * 4
            + [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["doc_id", "n", "fp", "fp2", "chunk", "data"],
        )

    schema = "doc_id bigint, n bigint, fp bigint, fp2 bigint, chunk int, data binary"
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, schema)
    return stored(rows.withColumn("task", F.spark_partition_id()), "set_summaries")


def _sketch(summaries: DataFrame, join: Join) -> np.ndarray:
    """All cells, added up in two levels; a task's cell counts 255 at most, which is frequent anyway."""

    def added(dtype, before):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(d.as_buffer(), dtype=before).astype(dtype) for d in table.column("data"))
            return pa.table({"chunk": table.column("chunk")[:1], "data": pa.array([total.tobytes()], pa.binary())})

        return run

    rows = summaries.filter("chunk IS NOT NULL").select("chunk", "data", (F.col("task") % 256).alias("some"))
    some = rows.groupBy("chunk", "some").applyInArrow(added(np.uint32, np.uint8), "chunk int, data binary")
    whole = some.groupBy("chunk").applyInArrow(added(np.uint32, np.uint32), "chunk int, data binary").collect()
    cells = np.zeros((1 << join.cells) // join.chunk * join.chunk, dtype=np.uint32).reshape(-1, join.chunk)
    for r in whole:  # a fixed number of chunks
        cells[r["chunk"]] = np.frombuffer(r["data"], dtype=np.uint32)
    return cells.reshape(-1)


def _levels(cells: np.ndarray) -> np.ndarray:
    """0 for cells like most, then one more for every doubling."""
    mean = cells.mean()
    usual = mean + 6 * np.sqrt(mean) + 20
    return np.clip(np.floor(np.log2(np.maximum(cells / usual, 0.5))) + 1, 0, 30).astype(np.uint8)


def boundary(cells: np.ndarray) -> int:
    """Size from which two-subsets are more than the list entries they replace, with the lists' mean length."""
    total = int(cells.sum(dtype=np.uint64))
    rare = cells[_levels(cells) == 0].astype(np.float64)
    held = rare.sum()
    # occurrences that share a shingle with a given one: the cells' mean by occurrence less a cell's chance filling
    length = 1 + max(0.0, (rare * rare).sum() / held - held / len(rare) - 1) if held and total else 1.0
    n = 3
    while comb(prefix_lengths(n, 2)[1], 2) <= prefix_lengths(n, 1)[1] * (1 + length):
        n += 1
    return n


# --- pass 2: keys to lists


def _coded(n: int) -> int:
    """15 bits of a size, in order, rounded down by less than 1 %."""
    return int(np.array([n], dtype=np.float32).view(np.uint32)[0] >> 16)


def _ordered(own: np.ndarray, level: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` shingles of a set in the global order."""
    rare = own[level == 0]
    if len(rare) >= count:
        return rare[:count]
    return own[np.argsort(level, kind="stable")[:count]]


def set_keys(own: np.ndarray, level: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether each is in the prefix as the smaller set)."""
    n = len(own)
    keys, small = [], []
    if n < edge and n > 2:  # smaller sets link with equal ones only
        as_small, as_large = prefix_lengths(n, 2)
        first = _ordered(own, level, as_large)
        i, j = np.triu_indices(len(first), 1)
        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        keys.append(shingles.mixed(low * _U(3) + shingles.mixed(high, 7), 9))
        small.append(j < as_small)
    if 100 * n >= PERCENT * edge:
        as_small, as_large = prefix_lengths(n, least_shared(n, edge))
        if n < edge:
            as_large = as_small
        keys.append(_ordered(own, level, as_large))
        small.append(np.arange(as_large) < as_small)
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return np.concatenate(keys), np.concatenate(small)


LISTS = "key bigint, spread boolean, members array<bigint>, sizes array<float>, small array<boolean>"


def _size(packed: np.ndarray) -> np.ndarray:
    return ((packed & _U(0x7FFF)) << _U(16)).astype(np.uint32).view(np.float32)


def _lists(table: pa.Table) -> pa.Table:
    """One bucket's lists, less sets that fit no other; lists of spread keys go on in other buckets and stay whole."""
    both = np.concatenate([np.frombuffer(d.as_buffer(), dtype=np.uint64).reshape(-1, 2) for d in table.column("data")])
    both = both[np.lexsort((both[:, 1], both[:, 0] >> _U(16)))]
    key, member = both[:, 0] >> _U(16), both[:, 1]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])  # a set of several copies
    both, key, member = both[fresh], key[fresh], member[fresh]
    # a set without another of fitting size in the list has none next to it in the order of sizes either
    order = np.lexsort((both[:, 0] & _U(0x7FFF), key))
    size = _size(both[order, 0])
    fits = np.zeros(len(key) + 1, dtype=bool)
    fits[1:-1] = (key[order][1:] == key[order][:-1]) & (size[:-1] * 1.01 >= size[1:] * (PERCENT / 100))
    keep = np.zeros(len(key), dtype=bool)
    keep[order] = fits[1:] | fits[:-1]
    keep |= (key & _U(1)) == 1
    both, key, member = both[keep], key[keep], member[keep]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    spread = (key[start] & _U(1)) == 1
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    size = _size(both[:, 0])
    small = (both[:, 0] & _U(0x8000)) != 0

    def nested(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return pa.table(
        {
            "key": pa.array(key[start].view(np.int64)), "spread": pa.array(spread),
            "members": nested(pa.array(member.view(np.int64))), "sizes": nested(pa.array(size)),
            "small": nested(pa.array(small)),
        }
    )


def _posted(docs: DataFrame, text: str, levels: np.ndarray, edge: int, join: Join) -> DataFrame:
    """The lists of all keys, stored."""
    n_buckets = bucket_count(docs)
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**cells bytes
    shift = _U(64 - join.cells)

    def sent(entries):
        bucket, packed, member = (np.concatenate(x) for x in zip(*entries))
        order = np.argsort(bucket, kind="stable")
        both = np.stack([packed[order], member[order]], axis=1)
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for i in range(n_buckets):
            if bounds[i] < bounds[i + 1]:
                data = pa.array([both[bounds[i] : bounds[i + 1]].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), data], names=["bucket", "data"])

    def run(batches):
        task = TaskContext.get().partitionId()
        level_of, seen, entries, held = shared.value, set(), [], 0
        for batch in batches:
            for own in shingles.sets(batch.column(0).to_pylist()):
                fp = int(shingles.mixed(own, 3).sum(dtype=np.uint64))
                if fp in seen:
                    continue
                seen.add(fp)
                keys, small = set_keys(own, level_of[own >> shift], edge)
                if not len(keys):
                    continue
                # 47 bits of the key, 1 for spread, 1 for the smaller set's prefix, 15 for the size
                level = level_of[keys >> shift]
                spread = level >= join.spread
                salt = np.where(spread, task % (1 << np.minimum(level, 20).astype(np.int64)), 0)
                bucket = ((keys % _U(n_buckets)).astype(np.int64) + salt) % n_buckets
                packed = (keys & _U(0xFFFFFFFFFFFE0000)) | (spread.astype(np.uint64) << _U(16))
                packed |= (small.astype(np.uint64) << _U(15)) | _U(_coded(len(own)))
                entries.append((bucket, packed, np.full(len(keys), fp, dtype=np.uint64)))
                held += len(keys)
                if held >= join.entries:
                    yield from sent(entries)
                    entries, held = [], 0
        if entries:
            yield from sent(entries)

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, data binary")
    return stored(rows.groupBy("bucket").applyInArrow(_lists, LISTS), "set_lists")


# --- pairs


def _fit(small: Column, large: Column) -> Column:
    return small * 1.01 >= large * (PERCENT / 100)


def _star_pairs(lists: DataFrame, turns: int, edge: int) -> DataFrame:
    """(a, b): every set b with those that it shares most lists with, among the heads of its lists.

    A list's head is its first set in an order drawn by hash, the same in all lists, and another each
    turn. The parts of a spread list have a head each; these go with the first head of all parts.
    """
    out = None
    for turn in range(turns):
        sets = F.transform(
            F.arrays_zip("members", "sizes"),
            lambda m: F.struct(
                F.xxhash64(F.lit(turn), m["members"]).alias("draw"), m["members"].alias("id"), m["sizes"].alias("size")  # noqa: B023
            ),
        )
        drawn = lists.select("key", "spread", F.explode(F.array(sets)).alias("sets"))
        own = drawn.select(F.array_min("sets").alias("x"), F.explode("sets").alias("y"))
        heads = drawn.filter("spread").select("key", F.array_min("sets").alias("y"))
        parts = heads.join(heads.groupBy("key").agg(F.min("y").alias("x")), "key").select("x", "y")
        pairs = own.unionByName(parts).filter(
            (F.col("x.id") != F.col("y.id")) & _fit(F.least("x.size", "y.size"), F.greatest("x.size", "y.size"))
        )
        shared = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.least("x.size", "y.size")).alias("size")
        ).filter(F.col("n") * 2 >= _least_shared(F.col("size"), edge))  # a list may have another head
        best = shared.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        out = best if out is None else out.unionByName(best)
    return out.select("a", "b").distinct()


def _reach(size: Column, place: Column) -> Column:
    """The largest set that may link by a shingle at this place (from 0) of a set's order, and share none before."""
    return F.floor((size - place) * (100 + PERCENT) / PERCENT + 1e-9) - size


def _rare_lists(own: DataFrame) -> DataFrame:
    """(key, m): lists of the sets in the order of exact counts, one per shingle of a prefix; m: (id, size, reach).

    own: (fp, shingles). A pair that links shares the first shingle that both have, and each one's size is
    within the other's reach there. Shingles of one set alone come first and make no list.
    """
    rows = own.select("fp", F.size("shingles").cast("bigint").alias("size"), F.explode("shingles").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    kept = rows.join(counts, "key").groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("own"))
    alone = F.col("size") - F.size("own")
    entries = kept.select("fp", "size", alone.alias("alone"), F.posexplode("own").alias("i", "x")).select(
        F.col("x.key").alias("key"),
        F.struct(F.col("fp").alias("id"), "size", _reach(F.col("size"), F.col("alone") + F.col("i")).alias("reach")).alias("m"),
    ).filter(F.col("m.reach") * 100 >= F.col("m.size") * PERCENT)
    entries = stored(entries, "rare_entries")
    least = entries.groupBy("key").agg(F.min("m.size").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(entries.join(least, "key").filter("m.reach >= least").select("key", "m"), "rare_lists")


def _within(x: Column, y: Column) -> Column:
    return (x["size"] <= y["reach"]) & (y["size"] <= x["reach"])


def _with_hubs(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(key, m, hub, n) of the lists that hold several components; n: sets in the list."""
    named = lists.join(found, F.col("m.id") == F.col("node"), "left").select(
        "key", "m", F.coalesce("component", "m.id").alias("hub")
    )
    named = stored(named, "list_members")
    # combined before the shuffle
    several = named.groupBy("key").agg(F.min("hub").alias("x"), F.max("hub").alias("y"), F.count(F.lit(1)).alias("n"))
    return stored(named.join(several.filter("x < y").select("key", "n"), "key"), "open_members")


def _first_pairs(members: DataFrame, short: int, turns: int) -> DataFrame:
    """(a, b): sets of different components that meet in a short list, or as a list's head and another.

    members: (key, m, hub, n). Short lists hold ``short`` sets at most; a head is drawn anew each turn.
    """
    draws = [F.min(F.struct(F.xxhash64(F.lit(t), "m.id"), "m", "hub")).alias(f"head{t}") for t in range(turns)]
    heads = members.groupBy("key").agg(*draws)
    named = stored(members.join(heads, "key"), "rare_heads")
    few = named.filter(F.col("n") <= short).select("key", "m", "hub")
    x, y = (few.select("key", F.struct("m", "hub").alias(side)) for side in ("x", "y"))
    out = x.join(y, "key").filter((F.col("x.m.id") < F.col("y.m.id")) & (F.col("x.hub") != F.col("y.hub")))
    out = out.filter(_within(F.col("x.m"), F.col("y.m"))).select(F.col("x.m.id").alias("a"), F.col("y.m.id").alias("b"))
    for t in range(turns):
        head = F.col(f"head{t}")
        far = named.filter((F.col("n") > short) & (head["hub"] != F.col("hub"))).filter(_within(head["m"], F.col("m")))
        out = out.unionByName(far.select(head["m"]["id"].alias("a"), F.col("m.id").alias("b")))
    return out.distinct()


def _hub_pairs(members: DataFrame, edge: int) -> DataFrame:
    """(a, b), a < b: hubs that meet in a list where sets of theirs could be a pair by size and place.

    members: (key, m, hub). A component counts once in a list, however many sets it has there.
    Without ``m.reach``, sizes alone decide; they are known to 1 % then.
    """
    reach = F.col("m.reach") if "reach" in members.schema["m"].dataType.names else F.col("m.size") * (101 / PERCENT)
    hubs = members.groupBy("key", "hub").agg(F.min("m.size").alias("size"), F.max(reach).alias("reach"))
    # lists of one component alone are done; minima are combined before the shuffle
    many = stored(
        hubs.groupBy("key").agg(F.min("hub").alias("x"), F.max("hub").alias("y")).filter("x < y").select("key"), "open_lists"
    )
    open_hubs = stored(hubs.join(many, "key", "left_semi"), "open_hubs")
    x = open_hubs.select("key", F.struct("hub", "size", "reach").alias("x"))
    y = open_hubs.select("key", F.struct("hub", "size", "reach").alias("y"))
    met = x.join(y, "key").filter((F.col("x.hub") < F.col("y.hub")) & _within(F.col("x"), F.col("y")))
    shared = met.groupBy(F.col("x.hub").alias("a"), F.col("y.hub").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.least(F.min("x.size"), F.min("y.size")).alias("size")
    )
    return shared.filter(F.col("n") >= _least_shared(F.col("size"), edge)).select("a", "b")


def _set_pairs(members: DataFrame, hubs: DataFrame, edge: int) -> DataFrame:
    """(a, b): candidates of two components, where the hubs' distance does not rule them out.

    hubs: (a, b, distance); members: (key, m, hub, away), away the distance to the hub. Jaccard distance
    is a metric, so two sets are at least distance - away - away apart.
    """
    x = members.select("key", F.col("hub").alias("a"), F.col("m").alias("x"), F.col("away").alias("dx"))
    y = members.select("key", F.col("hub").alias("b"), F.col("m").alias("y"), F.col("away").alias("dy"))
    met = x.join(hubs, "a").join(y, ["key", "b"]).filter(
        (F.col("distance") - F.col("dx") - F.col("dy") <= 1 - PERCENT / 100 + 1e-9) & _within(F.col("x"), F.col("y"))
    )
    shared = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("x.size", "y.size")).alias("size")
    )
    return shared.filter(F.col("n") >= _least_shared(F.col("size"), edge)).select("a", "b")


# --- exact comparison


def _texts(docs: DataFrame, lenders: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(fp, size, packed): compressed texts of one document per set."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(r) for r in raw], pa.int64()),
                    pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary()),
                ],
                names=["doc_id", "size", "packed"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string"))
    packed = rows.mapInArrow(run, "doc_id bigint, size bigint, packed binary")
    return packed.join(lenders, "doc_id").select("fp", "size", "packed")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both): the pairs' set and intersection sizes, from whole texts.

    texts are bucketed: each b meets its text there. The a's may be hubs of many pairs; theirs is a
    join of two shuffled sides, whose hot partitions Spark splits.
    """
    named = texts.select("fp", F.struct("size", "packed").alias("t"))
    heads = stored(named.join(pairs.select(F.col("a").alias("fp")).distinct(), "fp"), "heads")
    met = pairs.join(named.select(F.col("fp").alias("b"), F.col("t").alias("y")), "b").join(
        heads.select(F.col("fp").alias("a"), F.col("t").alias("x")), "a"
    )

    def run(batches):
        codec = pa.Codec("zstd")

        def own_set(t):
            raw = codec.decompress(t["packed"], decompressed_size=t["size"], asbytes=True)
            return next(shingles.sets([raw.decode("utf-8", "surrogatepass")]))

        last, x = None, None
        for batch in batches:
            counts = []
            for a, left, right in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if a != last:  # pairs of one hub come together
                    last, x = a, own_set(left)
                y = own_set(right)
                counts.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            columns = np.array(counts, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(columns[:, c]) for c in range(3))],
                names=["a", "b", "n_a", "n_b", "both"],
            )

    out = met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, both bigint")
    return stored(out, "compared")


def _own_shingles(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, shingles) of the sets, from their texts."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            packed = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            raw = [codec.decompress(data, decompressed_size=size, asbytes=True) for size, data in packed]
            own = list(shingles.sets([r.decode("utf-8", "surrogatepass") for r in raw]))
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            values = np.concatenate(own).view(np.int64) if own else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                names=["fp", "shingles"],
            )

    rows = texts.join(sets, "fp", "left_semi").select("fp", "size", "packed")
    return stored(rows.mapInArrow(run, "fp bigint, shingles array<bigint>"), "open_shingles")


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter(f"100 * both >= {PERCENT} * (n_a + n_b - both)").select("a", "b")


def _distance() -> Column:
    return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))


def _members(lists: DataFrame) -> DataFrame:
    """(key, m) of the lists; sizes are known to 1 %, and only the smaller set's prefix reaches larger ones."""
    zipped = F.arrays_zip(F.col("members").alias("id"), F.col("sizes").alias("size"), F.col("small").alias("small"))
    m = F.col("m")
    reach = m["size"] * F.when(m["small"], 101 / PERCENT).otherwise(1.01)
    return lists.select("key", F.explode(zipped).alias("m")).select(
        "key", F.struct(m["id"].alias("id"), m["size"].cast("double").alias("size"), reach.alias("reach")).alias("m")
    )


def _set_groups(lists: DataFrame, texts: DataFrame, edge: int, join: Join) -> DataFrame:
    """(node, component) of all sets that link with another."""
    links = _links(_compared(stored(_star_pairs(lists, join.turns, edge), "star_pairs"), texts))
    found = stored(components(links), "set_groups")
    opened = _with_hubs(_members(lists), found)
    # two sets that share too few short lists share a long one: both are in the new lists
    short, long = opened.filter(F.col("n") <= join.short).drop("n"), opened.filter(F.col("n") > join.short)
    rare = _rare_lists(_own_shingles(texts, stored(long.select(F.col("m.id").alias("fp")).distinct(), "open_sets")))
    first = _first_pairs(_with_hubs(rare, found), join.short, join.turns)
    links = links.unionByName(_links(_compared(stored(first, "first_pairs"), texts)))
    found = stored(components(links), "set_groups")
    short, rare = (_with_hubs(x.select("key", "m"), found).drop("n") for x in (short, rare))
    # distances of these sets to their component's hub, and of the hubs that meet in a list
    spokes = short.select("m.id", "hub").unionByName(rare.select("m.id", "hub")).filter("id <> hub")
    spokes = spokes.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    away = stored(
        _compared(stored(spokes, "spokes"), texts).select(F.col("b").alias("node"), F.col("a").alias("component"), _distance().alias("d")),
        "away",
    )
    short, rare = (
        stored(
            x.join(away.select("node", "d"), F.col("m.id") == F.col("node"), "left")
            .select("key", "m", "hub", F.coalesce("d", F.lit(0.0)).alias("away")),
            "placed",
        )
        for x in (short, rare)
    )
    hubs = _hub_pairs(short, edge).unionByName(_hub_pairs(rare, ONE_LIST)).distinct()
    met = _compared(stored(hubs, "hub_pairs"), texts)
    links = links.unionByName(_links(met))
    farthest = away.groupBy("component").agg(F.max("d").alias("d"))
    near = (
        met.select("a", "b", _distance().alias("distance"))
        .join(farthest.select(F.col("component").alias("a"), F.col("d").alias("da")), "a", "left")
        .join(farthest.select(F.col("component").alias("b"), F.col("d").alias("db")), "b", "left")
        .filter(F.col("distance") > 1 - PERCENT / 100)  # the others are linked
        .filter(F.coalesce("da", "db").isNotNull())  # two single sets: compared just now
        .filter(F.col("distance") - F.coalesce("da", F.lit(0.0)) - F.coalesce("db", F.lit(0.0)) <= 1 - PERCENT / 100 + 1e-9)
        .select("a", "b", "distance")
    )
    linked_hubs = stored(components(_links(met)), "hub_groups")
    group = lambda side: linked_hubs.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = near.join(group("a"), "a", "left").join(group("b"), "b", "left").filter(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")
    ).select("a", "b", "distance")
    apart = stored(apart, "near_hubs")
    rest = _set_pairs(short, apart, edge).unionByName(_set_pairs(rare, apart, ONE_LIST)).distinct()
    rest = _links(_compared(stored(rest, "set_pairs"), texts))
    return stored(components(links.unionByName(rest)), "set_groups")


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) per row of docs.

    set_id is the same for equal sets, and null for empty ones, whose component is their own id.
    """
    summaries = _summaries(docs, doc_id, text, join)
    rows = summaries.filter("chunk IS NULL").select("doc_id", "n", "fp")
    cells = _sketch(summaries, join)
    edge = boundary(cells)
    lists = _posted(docs, text, _levels(cells), edge, join)
    # the least document of every class that is in a list lends its text
    ends = stored(lists.select(F.explode("members").alias("fp")).distinct(), "list_ends")
    lenders = rows.filter("n > 0").join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    packed = _texts(docs, stored(lenders, "lenders"), doc_id, text)
    with bucketed(packed, "fp", "set_texts") as texts:
        found = _set_groups(lists, texts, edge, join)
    named = rows.join(found, F.col("fp") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("set_id"),
        F.when(F.col("n") > 0, F.coalesce("component", "fp")).alias("c"),
    )
    named = stored(named, "set_members")
    # most classes are alone: only those with several rows are joined back
    several = named.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    several = stored(several.filter("rows > 1").select("c", "least"), "set_least")
    return named.join(several, "c", "left").select(
        "doc_id", "n_shingles", "set_id", F.coalesce("least", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """docs with one row per component, that of the least doc_id; all columns as they are."""
    gone = stored(
        similar_sets(docs, doc_id, text, join).filter("doc_id <> component_id").select("doc_id").distinct(), "copies"
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
