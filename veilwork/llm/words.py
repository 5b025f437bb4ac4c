"""Words of many documents at once, as arrays: bounds, 64-bit hashes and hashes of word runs.

A word's hash is a sum over its eights of bytes, each mixed with its place, so no two words are alike by their
structure. A run of words i..j is a difference of prefix sums of hash * P**position modulo
2**64, times P**-i, so every window of a document is one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so invertible
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the bytes from each start to its end."""
    size = np.asarray(end) - start
    steps = np.maximum((size + 7) // 8, 1)
    first = np.cumsum(steps) - steps
    step = np.arange(int(steps.sum())) - np.repeat(first, steps)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    value = eights[np.repeat(start, steps) + 8 * step]
    left = np.repeat(size, steps) - 8 * step
    short = left < 8
    value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    mixed = mix(value ^ mix((step.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[which])))
    sums = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    return mix(sums + size.astype(np.uint64) * np.uint64(_BASES[1 - which]))


@lru_cache(maxsize=8)
def _powers(which: int, inverse: bool, size: int) -> np.ndarray:
    base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:  # doubling: p[n:2n] = p[:n] * base**n
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    return _powers(which, inverse, 1 << max(21, int(n).bit_length()))[:n]


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, False, len(values)), out=out[1:])
    return out


class Words:
    """Words of some texts: ``start`` and ``end`` in ``buf``; text d has words first[d]..first[d + 1]."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        blob = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(blob, np.uint8)
        if fold:
            self.buf = _FOLD[self.buf]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        space = np.ones(len(self.buf) + 1, bool)
        space[1:] = SPACE[self.buf]
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)
        self.n = len(self.start)

    def doc(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(self.n)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, which)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def runs(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` words, by its first word; texts are not told apart here."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(hashes, which)
    return mix((sums[length:] - sums[:n]) * powers(which, True, n))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Null is an empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in runs of about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        texts, begin, size = texts_of(batch), 0, 0
        for i, text in enumerate(texts):
            if i > begin and size + len(text) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
