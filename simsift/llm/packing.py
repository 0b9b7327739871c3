"""Packing of documents into fixed windows by dynamic programming.

The documents of a partition form one token stream in their order. Windows of at
most ``window`` tokens cut it; cuts fall on document ends, on sentence ends (the
document is truncated there and goes on in the next window) or, in a stretch of
``stretch`` tokens without either, every ``step`` tokens. Chosen are the cuts with the least

    sum over windows of (window - length) + sum over cuts of penalty(cut).

With cost(j) = penalty(j) + window - p(j) + min over i of (cost(i) + p(i)), where
p(j) - p(i) <= window, the minimum slides forward with j, and a monotone queue
yields it in constant time: a whole stream takes time linear in its places.

Streams are as long as a scan's partition. Rows are packed where they are read, with no
shuffle; a task holds one block of tokens, whose last window opens the next block. So
padding is that of the cuts and one open window per partition.

Each id of a document lies in exactly one piece. A null text is an empty one and has
the end token alone. Equal rows are packed each. Empty tables give an empty result.
Ids are those of the tokenizers library's plain call: a special token's string in a text is that token.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import blocks, encoder

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_PART_BITS = 33


#: Bytes of text that a worker takes at a time; ids and pieces do not depend on it. 8 MB took 667 MB of a worker, 2 MB 533.
TEXT_BLOCK = 1 << 21


@dataclass(frozen=True)
class Packing:
    """vocabulary: a byte-level file of the tokenizers library."""

    vocabulary: str
    window: int = 2048
    end_id: int = 1
    truncation: int = 8
    forced: int = 64
    stretch: int = 256
    step: int = 32
    block: int = 1 << 21


@lru_cache(maxsize=2)
def _sentence_ends(path: str) -> np.ndarray:
    """Per id: does a sentence end after it?"""
    names = encoder(path).library.get_vocab()
    ends = np.zeros(max(names.values()) + 1, dtype=bool)
    for token, i in names.items():
        ends[i] = token[-1:] in (".", "!", "?") or "Ċ" in token  # the byte-level alphabet's line break
    return ends


def places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, packing: Packing) -> tuple[np.ndarray, np.ndarray]:
    """(positions a window may end at, their penalties), ascending; position p is before id p."""
    after = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    at = np.union1d(after, doc_ends)
    at = at[at > 0]
    penalty = np.full(len(at), packing.truncation, dtype=np.int64)
    penalty[np.searchsorted(at, doc_ends)] = 0
    gaps = np.diff(at, prepend=0)
    forced = [
        np.arange(at[k] - gaps[k] + packing.step, at[k], packing.step)
        for k in np.flatnonzero(gaps > packing.stretch)
    ]
    if forced:
        more = np.concatenate(forced)
        order = np.argsort(np.concatenate([at, more]), kind="stable")
        penalty = np.concatenate([penalty, np.full(len(more), packing.forced)])[order]
        at = np.concatenate([at, more])[order]
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Ends of the windows of least cost; the last is at[-1]."""
    p = [0, *at.tolist()]
    pen = [0, *penalty.tolist()]
    back = [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost(i) + p(i), i), ascending in both
    push, pop, popleft = queue.append, queue.pop, queue.popleft
    for j in range(1, len(p)):
        pj = p[j]
        while pj - p[queue[0][1]] > window:
            popleft()
        least, i = queue[0]
        back[j] = i
        value = least + window + pen[j]  # cost(j) + p(j)
        while queue and queue[-1][0] >= value:
            pop()
        push((value, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


class _Stream:
    """Documents of one task: fills blocks, cuts them, keeps the open window."""

    def __init__(self, packing: Packing, first_sequence: int):
        self.packing, self.sequence = packing, first_sequence
        self.ends = _sentence_ends(packing.vocabulary)
        self.docs: list[tuple] = []  # (doc_id, ids from here on, ids before, ids in all)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.packing.end_id))
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows but the open one; with ``last`` of that too."""
        if not self.docs:
            return None
        ids = np.concatenate([d[1] for d in self.docs])
        lengths = np.array([len(d[1]) for d in self.docs])
        doc_ends = np.cumsum(lengths)
        cuts = best_cuts(*places(ids, doc_ends, self.ends, self.packing), self.packing.window)
        starts = np.array([0, *cuts[:-1]])
        done = int(cuts[-1] if last else starts[-1])
        doc_starts = doc_ends - lengths
        at = np.union1d(starts, doc_starts)
        at = at[at < done]
        ends = np.append(at[1:], done)
        doc = np.searchsorted(doc_starts, at, "right") - 1
        window = np.searchsorted(starts, at, "right") - 1
        before = np.array([d[2] for d in self.docs])[doc]
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[k][0] for k in doc], pa.int64()),
                pa.array(at - doc_starts[doc] + before, pa.int64()),
                pa.array(ends - at, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([self.docs[k][3] for k in doc], pa.int64()),
                pa.array(window + self.sequence, pa.int64()),
                pa.array(at - starts[window], pa.int64()),
            ],
            names=[field.split(" ")[0] for field in SCHEMA.split(", ")],
        )
        self.sequence += len(starts) if last else len(starts) - 1
        open_from = int(np.searchsorted(doc_ends, done, "right"))
        kept = self.docs[open_from:]
        if kept:
            doc_id, own, offset, total = kept[0]
            skip = done - int(doc_starts[open_from])
            kept[0] = (doc_id, own[skip:], offset + skip, total)
        self.docs, self.size = kept, len(ids) - done
        return out


def pack(docs: DataFrame, packing: Packing, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: a stretch of a document's ids in a sequence.

    Sequences are numbered within the scan's partition, whose number is above them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(packing, TaskContext.get().partitionId() << _PART_BITS)
        for batch in batches:
            for rows, texts in blocks(batch, 1, TEXT_BLOCK):
                flat, at = encoder(packing.vocabulary).ids(texts)
                for key, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    stream.add(key, flat[a:b])
                    if stream.size >= packing.block:
                        yield stream.cut(last=False)
        rest = stream.cut(last=True)
        if rest is not None:
            yield rest

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def public_packing(**options) -> Packing:
    """Packing with the public byte-level vocabulary installed on every node."""
    import public_tokenizers as P

    return Packing(P.path("byte_bpe_50k.json"), **options)
