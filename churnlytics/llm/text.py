"""Words and their hashes for whole Arrow batches of texts, in numpy.

The words of a text are the runs of bytes that are digits, letters (A-Z
lower-cased) or beyond ASCII; in UTF-8 that equals the contracts' pattern on
characters. Hashes are 64-bit polynomials over random byte values, finished by
a mixer; they do not depend on the place of a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEGMENT = 1 << 18  # bytes hashed at a time


def lower_table() -> np.ndarray:
    """Byte -> lower-cased word byte, 0 for separators."""
    t = np.zeros(256, np.uint8)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[a:b + 1] = np.arange(a, b + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


def split_table() -> bytes:
    """For ``bytes.translate``: separators become spaces, A-Z become a-z."""
    t = lower_table()
    return bytes(int(x) or 32 for x in t)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish of a 64-bit hash (splitmix)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class WordHasher:
    """Words of byte buffers: (start, end, hash), see the module's docstring."""

    def __init__(self, seed: int = 1):
        self.lower = lower_table()
        self.value = byte_values(seed)
        p = 0x9E3779B97F4A7C15 | 1
        inv = pow(p, -1, 1 << 64)
        n = SEGMENT + 1
        self.pw = self._powers(p, n)
        self.ipw = self._powers(inv, n)

    @staticmethod
    def _powers(p: int, n: int) -> np.ndarray:
        a = np.full(n, p, np.uint64)
        a[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(a, dtype=np.uint64)

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``data``: bytes; ``cuts``: places where a text begins (a word never
        spans one). Words longer than a segment are hashed piece by piece."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64)
        low = self.lower[data]
        is_word = low != 0
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = is_word[:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        starts = np.flatnonzero(is_word & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        after[cuts - 1] = False
        ends = np.flatnonzero(is_word & ~after) + 1
        hashes = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            i = 0
            while i < len(starts):
                at = starts[i]
                j = int(np.searchsorted(ends, at + SEGMENT, side="right"))
                if j <= i:  # one word beyond a segment
                    h = U64(0)
                    for k in range(int(at), int(ends[i]), SEGMENT):
                        part = self.value[low[k:min(k + SEGMENT, int(ends[i]))]]
                        h = mix(np.array([h + (part * self.pw[:len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
                    hashes[i] = h
                    i += 1
                    continue
                stop = ends[j - 1]
                s = np.zeros(stop - at + 1, np.uint64)
                np.cumsum(self.value[low[at:stop]] * self.pw[:stop - at], dtype=np.uint64, out=s[1:])
                a, b = starts[i:j] - at, ends[i:j] - at
                hashes[i:j] = mix((s[b] - s[a]) * self.ipw[a] + (b - a).astype(np.uint64))
                i = j
        return starts, ends, hashes


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    off = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * width).astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches, text: int = 1, most: int = 1 << 20):
    """Cut record batches into parts of at most ``most`` bytes of the text
    column (one row at least): bounded memory whatever the texts' lengths."""
    for batch in batches:
        col = batch.column(text)
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
        total = np.cumsum(size)
        i = 0
        while i < batch.num_rows:
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(i, j - i)
            i = j


def doc_words(hasher: WordHasher, col: pa.Array):
    """(data, offsets, start, end, hash, first): ``first[i]:first[i+1]`` are
    the words of text i."""
    data, off = string_buffer(col)
    start, end, h = hasher.words(data, off[:-1])
    first = np.searchsorted(start, off)
    return data, off, start, end, h, first
