"""Vectorised hashing of bytes, words and word n-grams.

A sequence x[0..n) is hashed as sum(T[x[i]] * B**i) modulo 2**64 with B odd, from prefix
sums: the sum over a slice times the inverse power of its start does not depend on where
the slice lies.  Every value is finished with an avalanche step.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd
STEP = 0xD6E8FEB86659FD93  # odd, for sequences of words
_MASK = (1 << 64) - 1
CHUNK = 1 << 20  # bytes hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
FOLD_TABLE = BYTE_TABLE.copy()
FOLD_TABLE[ord("A") : ord("Z") + 1] = BYTE_TABLE[ord("a") : ord("z") + 1]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(STEP)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """S with S[j] - S[i] the weighted sum over values[i:j]."""
    up, _ = powers.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.upto(len(sums) + 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    """Hashes of buf[start:end] for ascending, disjoint slices; works in pieces of CHUNK bytes."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo = int(start[i])
        sums = prefix_sums(table[buf[lo : int(end[j - 1])]], BYTE_POWERS)
        out[i:j] = slice_hashes(sums, start[i:j] - lo, end[i:j] - lo, BYTE_POWERS)
        i = j
    if len(BYTE_POWERS.up) > 16 * CHUNK:  # after an uncommonly long slice
        BYTE_POWERS.__init__(BASE)
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of adjoining texts: byte slices, owner, first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        word = ~SPACE[buf]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(buf)]
        begins[inner] |= word[inner]  # a text's first byte begins a word of its own
        self.start = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = inner[inner > 0] - 1
        ends[last] |= word[last]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # words of text d: first[d]:first[d + 1]
        self.is_word_byte = word

    def __len__(self) -> int:
        return len(self.start)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, fold: bool = False) -> np.ndarray:
        return slices(self.buf, self.start, self.end, FOLD_TABLE if fold else BYTE_TABLE)


def ngrams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n values; run i covers words[i:i+n]."""
    if len(words) < n:
        return np.empty(0, U64)
    out = np.empty(len(words) - n + 1, U64)
    for lo in range(0, len(out), CHUNK):
        hi = min(len(out), lo + CHUNK)
        sums = prefix_sums(words[lo : hi + n - 1], WORD_POWERS)
        _, down = WORD_POWERS.upto(hi - lo + n)
        out[lo:hi] = mix((sums[n:] - sums[:-n]) * down[: hi - lo] + U64((n * 0xE7037ED1A0B428DB + salt) & _MASK))
    return out


def within(length: int, first: np.ndarray, n: int) -> np.ndarray:
    """For runs of n words: whether the run lies inside one text."""
    inside = np.ones(max(0, length - n + 1), bool)
    for k in range(1, n):  # a run that starts k before a text's first word crosses into it
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < len(inside))]
        inside[at] = False
    return inside


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """(lo, hi) ranges of texts whose bytes together stay near ``most``; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
