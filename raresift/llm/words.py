"""Words, word hashes and shingles of whole Arrow text columns, computed on bytes with numpy.

A word is a maximal run of word bytes; its 64-bit hash is a keyed polynomial of its folded bytes, taken from prefix
sums, so cost follows the bytes and not the number of words. Texts are handled in slices of bounded bytes: memory
does not grow with the batch, only with the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 4 << 20  # bytes of text handled together
BLOCK = 1 << 20  # bytes hashed together


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(kind: str) -> np.ndarray:
    """Boolean table of word bytes. space: all but ASCII white space; alnum: ASCII letters, digits, bytes over 127."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[:] = True
        table[[32, 9, 10, 11, 12, 13]] = False
    else:
        table[128:] = True
        for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(a):ord(b) + 1] = True
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(batch, text_col: str, limit: int = SLICE):
    """Parts of an Arrow batch of at most ``limit`` bytes of text (one row at least)."""
    offsets, _ = text_buffers(batch.column(text_col))
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(batch))
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Splits text columns; ``hashes`` are equal exactly for equal folded words (64-bit)."""

    def __init__(self, kind: str = "space", seed: int = 1, lower: bool = True):
        rng = np.random.default_rng(seed)
        self.is_word = byte_class(kind)
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 32, 1 << 62)) * 8 + 5
        self._tables(BLOCK)

    def _tables(self, n: int) -> None:
        step = np.full(n + 1, self.base % (1 << 64), np.uint64)
        back = np.full(n + 1, pow(self.base, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        self.up, self.down = np.cumprod(step), np.cumprod(back)

    def split(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, start, end, folded bytes, row offsets)."""
        offsets, data = text_buffers(column)
        data = self.fold[data]
        word = self.is_word[data]
        if not len(data):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, data, offsets
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        before[cuts] = False
        after[cuts - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        return np.searchsorted(offsets[1:], start, side="right"), start, end, data, offsets

    def hashes(self, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for disjoint ascending ranges."""
        out = np.zeros(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(int(np.searchsorted(end, start[i] + BLOCK, side="right")), i + 1)
            lo, hi = int(start[i]), int(end[j - 1])
            if hi - lo >= len(self.up):
                self._tables(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.value[data[lo:hi]] * self.up[:hi - lo], out=total[1:])
            a, b = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64))
            i = j
        return out


def shingles(row: np.ndarray, words: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of 1 to k - 1 words gives its whole sequence once."""
    count = np.bincount(row, minlength=rows)
    out_row, out = [], []
    for m in range(1, k + 1):
        if m < k:  # only rows of exactly m words
            use = np.flatnonzero(count[row] == m) if len(row) else np.zeros(0, np.int64)
            r, w = row[use], words[use]
        else:
            r, w = row, words
        n = len(r) - m + 1
        if n <= 0:
            continue
        first = np.flatnonzero(r[:n] == r[m - 1:])
        h = np.full(len(first), m, np.uint64)
        for j in range(m):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[first + j])
        out_row.append(r[first])
        out.append(h)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out)


def shingle_sets(row: np.ndarray, words: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, distinct within a row and sorted by (row, hash)."""
    r, h = shingles(row, words, rows, k)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]
