"""Vectorised text kernels over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+``. White space is ASCII, so words are found on the
UTF-8 bytes; no text is decoded. Hashes are 64 bit: a polynomial over the bytes of a
word modulo 2**64, finished by a mixer. Texts are taken in pieces of about
``CHUNK`` bytes (a longer text alone), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of 64-bit hashes (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_MULT))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse, kept between calls."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK) + 1
        _powers[:] = []
        for base in (_MULT, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any byte ranges of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bytes, offsets): runs of texts of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of texts: ``starts``, ``ends`` and, by text, ``first`` (n + 1 word numbers)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = _SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        before[inner], after[inner - 1] = True, True
        self.space = space
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


_WINDOW = mix(np.arange(11, 43, dtype=np.uint64) * _U(_MULT)) | _U(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, one for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _U(width), np.uint64)
    for i in range(width):
        total = total * _U(3) + hashes[i : i + n] * _WINDOW[i]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """By text the sorted distinct hashes of its shingles: A-Z lowered, ``width`` words;
    fewer words give the whole sequence as one; no words give none."""
    data = lower(data)
    words = Words(data, offsets)
    hashes = Prefix(data)(words.starts, words.ends)
    full = windows(hashes, width)
    out = []
    for a, m in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if m >= width:
            out.append(np.unique(full[a : a + m - width + 1]))
        else:
            out.append(windows(hashes[a : a + m], m) if m else np.zeros(0, np.uint64))
    return out
