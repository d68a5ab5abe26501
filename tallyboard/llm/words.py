"""Words and shingles of whole texts as numpy arrays, from one pass over the bytes of an Arrow column.

UTF-8 bytes of 0x80 and above are always word bytes here, so no decoding is needed. Texts are worked
through in chunks of a few MB, whatever the size of the Arrow batch, so a task's memory does not grow
with the batch; one text larger than a chunk is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(word_byte) -> np.ndarray:
    return np.array([word_byte(b) for b in range(256)], dtype=bool)


#: `[^\x20\x09-\x0D]+`
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets (from 0) of runs of texts of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Word bounds of a chunk. Words of text i have the indices first[i] to first[i + 1] - 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = table[self.data]
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, dtype=bool)
        after[:-1] = inside
        # A text ends where the next begins, even inside a run of word bytes.
        before[offsets] = False
        after[offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, lo: int, hi: int) -> str:
        """Words lo to hi - 1, one space between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi])).decode()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    steps = np.full(1 << bits, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end], equal for equal bytes wherever they stand, mixed."""
    bits = max(20, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, bits)[starts])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words; runs across texts are among them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total = mix(total + hashes[j : j + n]) + np.uint64(j + 1)
    return total


def shingle_heads(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every shingle that lies within one text, and the number of that text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begun = np.cumsum(counts) - counts
    return np.arange(len(owner)) - begun[owner] + first[:-1][owner], owner


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..lengths[0]-1, 0..lengths[1]-1, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
