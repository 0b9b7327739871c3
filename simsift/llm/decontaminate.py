"""Benchmark items inside documents: MinHash containment search, verified exactly.

Words are runs of letters and digits, lower-cased. An item's set holds its distinct
five-word shingles (an item of fewer words: all of it as one shingle). A document
holds an item when it holds at least ``threshold`` of the item's shingles.

Search. Containment does not depend on the document's size, which may be a thousand
times the item's, so only items are sketched: by a bottom-k MinHash, the k smallest
shingle hashes. Items are partitioned by size in powers of two, and each partition has
the k that its largest size needs: an item that is contained misses at most
``(1 - threshold) * n`` shingles, so with one more in the sketch a document shares at
least one of them. No contained item is lost. A document's hashes above the
largest sketch hash are dropped before the join.

Verification counts the shingles themselves, as text, in each candidate document.

Items or documents that are null or without words never match. Equal rows count
as one; several items with one id are searched apart. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

WIDTH = 5
PERCENT = 75


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _each_window(w: Column, width: int, make) -> Column:
    """make(list of the window's words) for all windows of the word array w."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + k) for k in range(width)])
    )
    return F.when(F.size(w) >= width, windows).otherwise(F.array())


def hashes(w: Column, width: int) -> Column:
    return _each_window(w, width, lambda g: F.xxhash64(*g))


def shingles(w: Column, width: int) -> Column:
    return F.array_distinct(_each_window(w, width, lambda g: F.concat_ws(" ", *g)))


def _with_words(df: DataFrame, text: str) -> DataFrame:
    """One-element explode: the words are computed once for all their uses."""
    return df.withColumn("_w", F.explode(F.array(words(F.col(text)))))


def item_sets(items: DataFrame, item_id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """(_item, item_id, width, shingles, n, k): k is the sketch size of the item's partition."""
    found = _with_words(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_t")).distinct(), "_t")
    width = F.least(F.size("_w"), F.lit(WIDTH))
    by_width = F.coalesce(*[F.when(width == k, shingles(F.col("_w"), k)) for k in range(1, WIDTH + 1)])
    sets = found.filter(F.size("_w") > 0).select(
        F.monotonically_increasing_id().alias("_item"), "item_id", width.alias("width"),
        by_width.alias("shingles"),
    )
    n = F.size("shingles")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1  # of the partition
    k = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return stored(sets.withColumns({"n": n, "k": F.least(n, k)}), "items")


def sketches(sets: DataFrame) -> DataFrame:
    """(_item, width, h): the k smallest shingle hashes of every item."""
    def rehashed(width: int) -> Column:
        return F.transform("shingles", lambda s: F.xxhash64(*[F.split(s, " ")[i] for i in range(width)]))

    by_width = F.coalesce(*[F.when(F.col("width") == k, rehashed(k)) for k in range(1, WIDTH + 1)])
    smallest = F.slice(F.array_sort(by_width), F.lit(1), F.col("k"))
    return stored(sets.select("_item", "width", F.explode(smallest).alias("h")), "sketches")


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by its content; two rows with one key are both verified."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def candidates(docs: DataFrame, sketch: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_key, _item): documents that share a sketch hash with an item."""
    tops = {r["width"]: r["top"] for r in sketch.groupBy("width").agg(F.max("h").alias("top")).collect()}
    base = _with_words(docs.select(row_key(doc_id, text).alias("_key"), F.col(text).alias("_t")), "_t")
    found = None
    for width, top in sorted(tops.items()):  # WIDTH at most
        low = F.filter(hashes(F.col("_w"), width), lambda h: h <= F.lit(top))
        one = base.select("_key", F.explode(low).alias("h")).join(
            sketch.filter(F.col("width") == width).select("h", "_item"), "h"
        ).select("_key", "_item")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = base.select("_key", F.lit(None).cast("bigint").alias("_item")).limit(0)
    return stored(found.distinct(), "candidates")


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """(_key, doc_id, item_id, n_shingles, n_found): all documents and the items they hold."""
    sets = item_sets(items, item_id, item_text, percent)
    pairs = candidates(docs, sketches(sets), doc_id, text)
    rows = docs.select(
        row_key(doc_id, text).alias("_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")
    )
    # the stored candidates are few as a rule: Spark broadcasts them by their size or merges
    wanted = _with_words(rows.join(pairs, "_key"), "_t").join(sets, "_item")
    own = F.coalesce(*[
        F.when(F.col("width") == k, F.size(F.array_intersect(shingles(F.col("_w"), k), "shingles")))
        for k in range(1, WIDTH + 1)
    ])
    return (
        wanted.select("_key", "doc_id", "item_id", F.col("n").alias("n_shingles"), own.alias("n_found"))
        .filter(F.col("n_found") * 100 >= F.col("n_shingles") * percent).distinct()
    )


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs less those that hold an item; all columns as they are."""
    hit = stored(contained(docs, items, doc_id, text, **names).select("_key").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("_key"))
    return rows.join(hit, "_key", "left_anti").select("row.*")
