"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Such a vocabulary cuts a text by a pattern first and merges inside the cuts only, so a
text may be encoded in chunks wherever the pattern is sure to cut. These places are
found for a whole block of texts at once, on its bytes; the distinct chunks of a block go
to the library, and those already seen in the worker come from a bounded memory:

* before white space that follows a character which is none;
* between a letter or digit of ASCII and a punctuation mark of ASCII, but not after an apostrophe.

Ids are those of the library's plain call (a test holds them against it). A text
with the string of a special token goes to the library as a whole.

A sentencepiece model is used in the same way, with cuts before runs of spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks a worker remembers, some 200 bytes each, in two halves; ids do not depend on it. A worker
#: that waits for another stage's tasks keeps them, beside that stage's own memory.
REMEMBERED = 500_000

_SPACES = bytes([*range(0x09, 0x0E), 0x20])
_WORD = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_PLAIN = bytes(range(0x21, 0x7F))


def _bits(*kinds: tuple[bytes, int]) -> bytes:
    table = np.zeros(256, dtype=np.uint8)
    for members, bit in kinds:
        table[list(members)] |= bit
    return table.tobytes()


# A cut where the bits of a byte and of the one before meet; bit 4: only if the character before is no space.
_BEYOND = bytes(range(0x80, 0x100))
_MARKS = bytes(set(_PLAIN) - set(_WORD))
_HERE = _bits((_SPACES, 1 | 4), (_MARKS, 2), (_WORD, 8))
_BEFORE = _bits((_PLAIN, 1), (_WORD, 2), (_BEYOND, 4), (bytes(set(_MARKS) - set(b"'")), 8))
# Leads of the characters beyond ASCII among which there is white space, of two and of three bytes.
_SPACE_LEAD_2, _SPACE_LEAD_3 = np.array([0xC2]), np.array([0xE1, 0xE2, 0xE3])

# Chunks that may stand between line breaks without meeting them in one cut.
_APART = re.compile(rb" ?(?:[!-~]|\xc3.)(?:[^\n]*(?:[!-~]|\xc3.))?", re.S)


def cuts(data: bytes, doc_starts: np.ndarray) -> np.ndarray:
    """Ascending places of ``data``, UTF-8 of texts one after the other, where chunks begin."""
    meet = np.zeros(len(data), dtype=np.uint8)
    here, before = (np.frombuffer(data.translate(t), dtype=np.uint8) for t in (_HERE, _BEFORE))
    np.bitwise_and(here[1:], before[:-1], out=meet[1:])
    beyond = np.flatnonzero(meet == 4)
    if len(beyond):
        # the character before ends one byte before; its lead is the byte before that, or one more of three
        raw = np.frombuffer(data, dtype=np.uint8)
        two, three = raw[np.maximum(beyond - 2, 0)], raw[np.maximum(beyond - 3, 0)]
        meet[beyond[np.isin(two, _SPACE_LEAD_2) | np.isin(three, _SPACE_LEAD_3)]] = 0
    meet[doc_starts[doc_starts < len(data)]] = 1
    return np.flatnonzero(meet)


class _Chunked:
    """Ids of texts by chunks; a vocabulary says where it cuts and how it encodes chunks not seen before."""

    def __init__(self, marks: list[bytes], remembered: int):
        self.marks, self.remembered, self.seen = marks, remembered, dict[bytes, bytes]()
        self.older = dict[bytes, bytes]()  # the half before; what is still used moves over

    def _whole(self, text: bytes) -> bytes:
        """Ids of a text with a mark, which chunks do not suit."""
        raise NotImplementedError

    def _cuts(self, data: bytes, doc_starts: np.ndarray) -> np.ndarray:
        return cuts(data, doc_starts)

    def _learn(self, chunks: list[bytes]) -> None:
        raise NotImplementedError

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin and the last's end)."""
        marked = {i: self._whole(t) for i, t in enumerate(texts) if any(m in t for m in self.marks)}
        flat, bounds = self._by_chunks([b"" if i in marked else t for i, t in enumerate(texts)])
        if not marked:
            return flat, bounds
        whole = [
            np.frombuffer(marked[i], dtype="<u4") if i in marked else flat[a:b]
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        ]
        return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(w) for w in whole])])

    def _by_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes, data = np.array([len(t) for t in texts], dtype=np.int64), b"".join(texts)
        ends = np.cumsum(sizes)
        at = self._cuts(data, ends - sizes)
        chunks = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        ends_at = np.frombuffer(chunks.dictionary.buffers()[1], dtype=np.int64)[: len(chunks.dictionary) + 1].tolist()
        named = chunks.dictionary.buffers()[2].to_pybytes() if len(at) else b""
        distinct = [named[a:b] for a, b in zip(ends_at[:-1], ends_at[1:])]
        if 2 * (len(distinct) + len(self.seen)) > self.remembered:
            self.older, self.seen = self.seen, {}
        fresh = [c for c in distinct if c not in self.seen]
        self.seen.update((c, self.older[c]) for c in fresh if c in self.older)
        self._learn([c for c in fresh if c not in self.seen])
        parts = [self.seen[c] for c in distinct]
        index = chunks.indices.to_numpy()
        flat, n = gathered(np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, index)
        # ids before each chunk, then before each text
        before = np.concatenate([[0], np.cumsum(n)])
        starts = before[np.searchsorted(at, ends - sizes)]
        return flat, np.append(starts, before[-1])


class Encoder(_Chunked):
    """Ids by a file of the tokenizers library; ``plain_marks`` takes the strings of special tokens as ordinary text."""

    def __init__(self, path: str, plain_marks: bool = False, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_marks
        split = self.library.pre_tokenizer
        if not isinstance(split, pre_tokenizers.ByteLevel) or self.library.normalizer is not None:
            raise ValueError(f"{path} is no byte-level vocabulary without a normaliser")
        if not split.use_regex or split.add_prefix_space:
            raise ValueError(f"{path} cuts texts in another way")
        marks = self.library.get_added_tokens_decoder().values()
        super().__init__([] if plain_marks else [t.content.encode() for t in marks], remembered)
        self.size = self.library.get_vocab_size()
        self.line_break = self.library.encode("\n", add_special_tokens=False).ids[0]

    def _whole(self, text: bytes) -> bytes:
        ids = self.library.encode(text.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks: many in one call, between line breaks, where those are sure to stay tokens of their own."""
        apart = [c for c in chunks if _APART.fullmatch(c)]
        text = b"\n".join(apart).decode()
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.line_break), len(ids))
        raw, a = ids.tobytes(), 0
        for chunk, b in zip(apart, (4 * ends).tolist(), strict=True) if apart else ():
            self.seen[chunk] = raw[a:b]
            a = b + 4
        self.seen.update((c, self._whole(c)) for c in chunks if c not in self.seen)


class PieceEncoder(_Chunked):
    """Ids by a sentencepiece model of texts that begin with the space the model puts before a text.

    Its pieces hold spaces in front only, so none lies across the beginning of a run of spaces.
    That space alone, an empty text's, is the piece of a space.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        super().__init__(["▁".encode()], remembered)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path} has pieces with a space inside")
        self.space = np.array([self.library.piece_to_id("▁")], dtype="<u4").tobytes()

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text[1:].decode()), dtype="<u4").tobytes()

    def _cuts(self, data: bytes, doc_starts: np.ndarray) -> np.ndarray:
        space = np.frombuffer(data, dtype=np.uint8) == 0x20
        space[1:] &= ~space[:-1].copy()
        space[doc_starts[doc_starts < len(data)]] = True
        return np.flatnonzero(space)

    def _learn(self, chunks: list[bytes]) -> None:
        found = self.library.encode([c[1:].decode() for c in chunks], num_threads=1) if chunks else []
        self.seen.update((c, np.array(ids, dtype="<u4").tobytes()) for c, ids in zip(chunks, found, strict=True))
        self.seen[b" "] = self.space  # the call's text would be empty


def gathered(values: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (their lengths given) in the order of ``index``, and the length of each."""
    firsts = np.cumsum(lengths) - lengths
    n = lengths[index]
    shift = firsts[index] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(n.sum())], n


@lru_cache(maxsize=4)
def encoder(path: str, plain_marks: bool = False, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path, plain_marks, remembered)


@lru_cache(maxsize=4)
def piece_encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """The worker's encoder of a sentencepiece model."""
    return PieceEncoder(path, remembered)


def blocks(batch: pa.RecordBatch, text: int, limit: int = 1 << 23) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``limit`` bytes of text, with their texts; a null text is empty."""
    column = batch.column(text)
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    first, size, texts = 0, 0, []
    for i, value in enumerate(raw):
        texts.append(value.as_py() or b"")
        size += len(texts[-1])
        if size >= limit or i + 1 == len(raw):
            yield batch.slice(first, i + 1 - first), texts
            first, size, texts = i + 1, 0, []
