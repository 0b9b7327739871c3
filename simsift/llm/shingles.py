"""Sets of word shingles as 64-bit hashes, a batch of texts at a time.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A set
holds the distinct shingles of ``width`` words; a text with fewer words has its
whole sequence as one; one without words has none. Two different shingles share a
hash with a chance of 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WIDTH = 5
#: Bytes of text hashed at a time; a longer text is a batch of its own.
BATCH = 1 << 20

_FOLD = bytes(
    0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(a random number per byte, odd factors of a shingle's words)."""
    draw = np.random.default_rng(20240607)
    per_byte = draw.integers(1, 2**63, 256, dtype=np.uint64)
    per_byte[0x20] = 0
    return per_byte, draw.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9 + 2 * seed)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of the words, their hashes); raw is folded and ends with a space."""
    per_byte, _ = _tables()
    code = np.frombuffer(raw, dtype=np.uint8)
    space = code == 0x20
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(max(BATCH + 1, 1 << int(len(code)).bit_length()))
    total = np.cumsum(per_byte[code] * power[: len(code)])
    before = np.where(start > 0, total[start - 1], _U(0))
    return start, mixed((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64))


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, folded texts) in runs of ``BATCH`` bytes."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        if run and size + len(raw) > BATCH:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    _, factor = _tables()
    for _, run in batches(texts):
        start, word = _words(b" ".join(run) + b" ")
        ends = np.cumsum([len(r) + 1 for r in run])
        bounds = np.searchsorted(start, ends)
        n = max(len(word) - WIDTH + 1, 0)
        shingle = np.zeros(n, dtype=np.uint64)
        for k in range(WIDTH):
            shingle += word[k : k + n] * factor[k]
        shingle = mixed(shingle)
        low = 0
        for high in bounds.tolist():
            count = high - low
            if count >= WIDTH:
                yield np.unique(shingle[low : high - WIDTH + 1])
            elif count:
                # the factor that no word has takes the number of words
                whole = np.append(word[low:high], _U(count)) * np.append(factor[:count], factor[WIDTH])
                yield mixed(whole.sum(dtype=np.uint64, keepdims=True), 1)
            else:
                yield np.zeros(0, dtype=np.uint64)
            low = high
