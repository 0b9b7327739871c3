"""Alignment of two tokenizers' tokens on the same text.

Side A is a byte-level BPE vocabulary and reads a space and the text; side B is a sentencepiece model, which puts that
space itself. Tokens of either side are stretches of the same bytes. A batch's tokens of one side are joined as of their
starts, keyed by document, to those of the other: each start finds the token that covers it. The union of both
directions is all overlaps. Overlaps that end together cut the text into groups and are its links.

A pair of ids counts how many links of the corpus hold it. Most links are of few pairs, so counts are looked up in two
ways that together cover every link: pairs that hold at least one of ``known`` equal parts of all links are at most
``known``, by that definition, and go to the tasks as arrays; the others, none of which is frequent, are joined by a
shuffle on the pair.

Null and empty texts, and those whose tokens do not spell the text (a text with the model's own mark for a space, say),
have no tokens: zeros and an empty digest. A text is read whole. Rows are aligned one by one, so equal rows and null or
repeated doc_ids all count; ties for a B id's highest count are all highest. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .tables import small_batches
from .vocabulary import blocks, encoder, piece_encoder

ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "a array<int>, b array<int>"
)
#: Links a task looks up at once, but for a longer document.
AT_ONCE = 1 << 20
OVERLAPS = (
    "doc_id bigint, a_index bigint, b_index bigint, a_id int, b_id int, a_start bigint, a_end bigint, b_start bigint, "
    "b_end bigint"
)


@dataclass(frozen=True)
class Pairing:
    """a: file of the tokenizers library; b: file of a sentencepiece model; remembered: chunks a worker keeps of each."""

    a: str
    b: str
    known: int = 1 << 17
    remembered: int = 300_000


# ---- tokens of both sides -------------------------------------------------------

class _Sides:
    """Both vocabularies: ids of texts, and per id the bytes it stands for."""

    def __init__(self, pairing: Pairing):
        self.a = encoder(pairing.a, True, pairing.remembered)
        vocabulary = self.a.library.get_vocab()
        names = {i: name for name, i in vocabulary.items()}
        self.a_bytes = pa.array([_byte_level(names.get(i, "")) for i in range(max(names) + 1)], pa.large_binary())
        self.b = piece_encoder(pairing.b, pairing.remembered)
        self.b_bytes = pa.array([self._piece(i) for i in range(self.b.library.get_piece_size())], pa.large_binary())
        # what a token adds to the text of the groups: within its group, and as the last of its side there
        self.said = pa.array(
            [
                form % i
                for n, forms in ((len(self.a_bytes), (b"%d,", b"%d|")), (len(self.b_bytes), (b"%d,", b"%d;")))
                for i in range(n)
                for form in forms
            ],
            pa.large_binary(),
        )

    def _piece(self, i: int) -> bytes:
        piece = self.b.library.id_to_piece(i)
        if self.b.library.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def tokens(self, texts: list[bytes]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Tokens of the texts that both sides spell: doc, id, start, end; places count over all of them."""
        spaced = [b" " + t for t in texts]
        a_ids, a_bounds = self.a.ids(spaced)
        b_ids, b_bounds = self.b.ids(spaced)
        spelt = np.array([len(t) > 1 for t in spaced])
        ends = []
        for table, ids, bounds in ((self.a_bytes, a_ids, a_bounds), (self.b_bytes, b_ids, b_bounds)):
            at, data = _concatenated(table, ids)
            ends.append(at[1:])
            doc_at = at[bounds].tolist()
            spelt &= [data[x:y] == t for x, y, t in zip(doc_at[:-1], doc_at[1:], spaced, strict=True)]
        return tuple(
            _frame(ids, bounds, end, spelt)
            for ids, bounds, end in ((a_ids, a_bounds, ends[0]), (b_ids, b_bounds, ends[1]))
        )


def _concatenated(table: pa.Array, index: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(where each entry begins and the last ends, the table's entries at ``index`` one after the other)."""
    taken = table.take(pa.array(index))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(index) + 1] if len(index) else np.zeros(1, dtype=np.int64)
    return at, taken.buffers()[2].to_pybytes() if len(index) else b""


def _byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: each character stands for one byte."""
    return bytes(map(_byte_of().__getitem__, token)) if all(c in _byte_of() for c in token) else token.encode()


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _sides(pairing: Pairing) -> _Sides:
    return _Sides(pairing)


def _frame(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray, used: np.ndarray) -> pd.DataFrame:
    """Tokens of the used texts; both sides spell these in the same bytes, so their places agree."""
    n = np.diff(bounds)
    kept = np.repeat(used, n)
    size = np.diff(ends, prepend=0)[kept]
    end = np.cumsum(size)
    return pd.DataFrame(
        {"doc": np.repeat(np.arange(len(n)), n)[kept], "start": end - size, "end": end, "id": ids[kept].astype(np.int64), "at": np.arange(len(end))},
        copy=False,
    )


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a_at, b_at, a_end, b_end) of all pairs of tokens that share bytes.

    Of two that overlap one starts inside the other, or both start together; the
    second direction leaves the latter out, as the first has them.
    """
    starts = [t[["doc", "start", "at"]] for t in (a, b)]
    under = pd.merge_asof(*starts, on="start", by="doc")
    over = pd.merge_asof(*reversed(starts), on="start", by="doc")
    a_at, b_at = over["at_y"].to_numpy(), over["at_x"].to_numpy()
    inside = a["start"].to_numpy()[a_at] != b["start"].to_numpy()[b_at]
    a_at = np.concatenate([under["at_x"].to_numpy(), a_at[inside]])
    b_at = np.concatenate([under["at_y"].to_numpy(), b_at[inside]])
    return pd.DataFrame(
        {"a_at": a_at, "b_at": b_at, "a_end": a["end"].to_numpy()[a_at], "b_end": b["end"].to_numpy()[b_at]}, copy=False
    )


def _digests(sides: _Sides, a: pd.DataFrame, b: pd.DataFrame, a_cut: np.ndarray, b_cut: np.ndarray, n_docs: int) -> list[str]:
    """sha256 of each document's groups as text, '' without tokens; the cuts are the last tokens of the groups."""
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    # within a group A's tokens come first: each token's place follows from how many of the other side come before it
    for tokens, own, other, first in (
        (a, a_cut, np.append(0, b_cut + 1), 0), (b, b_cut, np.append(a_cut + 1, 0), 2 * len(sides.a_bytes)),
    ):
        last = np.zeros(len(tokens), dtype=np.int64)
        last[own] = 1
        group = np.cumsum(last) - last
        codes[np.arange(len(tokens)) + other[group]] = first + 2 * tokens["id"].to_numpy() + last
    n = sum(np.bincount(t["doc"], minlength=n_docs) for t in (a, b))
    at, said = _concatenated(sides.said, codes)
    doc_at = at[np.concatenate([[0], np.cumsum(n)])].tolist()
    return [hashlib.sha256(said[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(doc_at[:-1], doc_at[1:])]


# ---- tables -----------------------------------------------------------------------

def _per_block(docs: DataFrame, pairing: Pairing, make: Callable, schema: str, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(pairing)
        for batch in batches:
            for rows, texts in blocks(batch, 2, 1 << 20):
                a, b = sides.tokens(texts)
                yield make(sides, rows, a, b, overlaps(a, b))

    rows = docs.select(F.monotonically_increasing_id(), F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, schema)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _aligned(sides: _Sides, rows: pa.RecordBatch, a: pd.DataFrame, b: pd.DataFrame, found: pd.DataFrame) -> pa.RecordBatch:
    links = found["a_end"].to_numpy() == found["b_end"].to_numpy()
    a_at, b_at = (np.sort(found[c].to_numpy()[links]) for c in ("a_at", "b_at"))  # both rise with the common end
    n_a, n_b = (np.bincount(t["doc"], minlength=len(rows)) for t in (a, b))
    n_links = np.bincount(a["doc"].to_numpy()[a_at], minlength=len(rows))
    return pa.RecordBatch.from_arrays(
        [
            # no token is empty, so one of each side ends with a group: a group and a link each
            rows.column(0), rows.column(1), *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_links, n_links)),
            pa.array(_digests(sides, a, b, a_at, b_at, len(rows)), pa.string()),
            _lists(a["id"].to_numpy()[a_at], n_links), _lists(b["id"].to_numpy()[b_at], n_links),
        ],
        names=[c.split(" ")[0] for c in ALIGNED.split(", ")],
    )


def _sizes(a: pd.DataFrame, n_docs: int) -> np.ndarray:
    """Bytes of each document's tokens."""
    return np.bincount(a["doc"], weights=a["end"] - a["start"], minlength=n_docs).astype(np.int64)


def _spans(sides: _Sides, rows: pa.RecordBatch, a: pd.DataFrame, b: pd.DataFrame, found: pd.DataFrame) -> pa.RecordBatch:
    found = found.sort_values(["a_at", "b_at"])
    left, right = a.iloc[found["a_at"].to_numpy()], b.iloc[found["b_at"].to_numpy()]
    doc = left["doc"].to_numpy()
    sizes = _sizes(a, len(rows))
    base = (np.cumsum(sizes) - sizes)[doc]
    firsts = [np.searchsorted(t["doc"].to_numpy(), doc) for t in (a, b)]
    cells = [
        left["at"].to_numpy() - firsts[0], right["at"].to_numpy() - firsts[1], left["id"].to_numpy(), right["id"].to_numpy(),
        *(t[c].to_numpy() - base for t in (left, right) for c in ("start", "end")),
    ]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays(
        [rows.column(1).take(pa.array(doc)), *(pa.array(c, t) for c, t in zip(cells, types, strict=True))],
        names=[c.split(" ")[0] for c in OVERLAPS.split(", ")],
    )


def token_overlaps(docs: DataFrame, pairing: Pairing, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per pair of tokens that share bytes: their places among the document's tokens, ids and byte ranges."""
    return _per_block(docs, pairing, _spans, OVERLAPS, doc_id, text)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): links per pair of ids, and whether no pair of the B id has more."""
    counts = stored(aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per B id of the vocabulary
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_known(aligned: DataFrame, known: pd.DataFrame) -> DataFrame:
    """aligned with the sums over links of known pairs, and the links of the others."""
    keys = (known["a"].to_numpy(np.int64) << 32) | known["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    n, best = np.append(known["n"].to_numpy(np.int64)[order], 0), np.append(known["best"].to_numpy(bool)[order], False)

    def looked_up(rows: pa.RecordBatch) -> pa.RecordBatch:
        *heads, a_lists, b_lists = rows.columns
        a, b = (x.flatten().to_numpy().astype(np.int64) for x in (a_lists, b_lists))
        doc = np.repeat(np.arange(len(rows)), np.diff(a_lists.offsets.to_numpy()))
        pair = (a << 32) | b
        at = np.searchsorted(keys, pair)
        is_known = keys[at] == pair
        sums = np.zeros((2, len(rows)), dtype=np.int64)
        for out, values in zip(sums, (best, n), strict=True):
            np.add.at(out, doc[is_known], values[at[is_known]])
        left = np.bincount(doc[~is_known], minlength=len(rows))
        return pa.RecordBatch.from_arrays(
            [*heads, *(pa.array(s) for s in sums), _lists(a[~is_known], left), _lists(b[~is_known], left)],
            names=[*rows.schema.names[:-2], "n_best", "count_sum", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = batch.column(-1).offsets.to_numpy()
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + AT_ONCE, "right")) - 1)
                yield looked_up(batch.slice(first, last - first))
                first = last

    schema = ALIGNED.replace("a array<int>, b array<int>", "n_best bigint, count_sum bigint, a array<int>, b array<int>")
    return aligned.mapInArrow(run, schema)


def aligned(docs: DataFrame, pairing: Pairing, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with small_batches(spark):
        links = stored(_per_block(docs, pairing, _aligned, ALIGNED, doc_id, text), "links")
    pairs = stored(pair_counts(links), "pair_counts")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    # n * known >= total: at most ``known`` pairs
    known = pairs.filter(F.col("n") * pairing.known >= total).toPandas()
    with small_batches(spark):
        half = stored(_with_known(links, known), "known")
    rest = (
        half.select("row", F.inline(F.arrays_zip("a", "b"))).join(pairs, ["a", "b"])
        .groupBy("row").agg(F.sum(F.col("best").cast("bigint")).alias("_best"), F.sum("n").alias("_sum"))
    )
    whole = half.drop("a", "b").join(rest, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
