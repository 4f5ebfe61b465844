"""Vectorised text kernels shared by the corpus operators.

Everything here works on a slice of an Arrow string column as one flat
``uint8`` buffer plus document offsets, so the per-byte work runs in numpy and
never in a Python loop.  Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document makes a slice of its own.
SLICE_BYTES = 256_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive slices of a string column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for exponents 0..n-1."""
    if len(_powers[0]) < n:
        n2 = max(n, SLICE_BYTES + 1024)
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                x = np.full(n2, b, np.uint64)
                x[0] = 1
                _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(30))


class Hasher:
    """Hashes of any byte spans of one buffer, from prefix sums of a polynomial."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.h = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[buf] * up[: len(buf)], dtype=np.uint64, out=self.h[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.h[end] - self.h[start]) * self.down[start]
            return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k bytes; length n - k + 1."""
        n = len(self.h) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.h[k:] - self.h[: n - k + 1]) * self.down[: n - k + 1])


def byte_class(fill: bool, **change: bytes) -> np.ndarray:
    t = np.full(256, fill)
    for value, chars in ((True, change.get("on", b"")), (False, change.get("off", b""))):
        t[np.frombuffer(chars, np.uint8)] = value
    return t


#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII digits and letters, and all of any code point above U+007F.
WORD = byte_class(False, on=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Bytes of tokens: anything but ASCII white space.
TOKEN = byte_class(True, off=b"\x20\x09\x0a\x0b\x0c\x0d")


def runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of the class, not crossing documents."""
    inside = table[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    if len(cut):
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's items start, for items in document order; length n + 1."""
    return np.searchsorted(doc, np.arange(n + 1))


def combine(h: np.ndarray, k: int, steps: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of h[i], h[i+s1], ... for each i; by default k neighbours. Ends that do not fit are left out."""
    steps = steps or tuple(range(k))
    m = len(h) - steps[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for s in steps:
            out = (out ^ h[s : s + m]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by doubling; length n - w + 1."""
    if len(x) < w:
        return np.zeros(0, x.dtype)
    m, k = x, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return m if k == w else np.minimum(m[: len(x) - w + 1], m[w - k : w - k + len(x) - w + 1])


def cuts(mask_len: int, off: np.ndarray, reach: int) -> np.ndarray:
    """True for starts i whose i .. i+reach-1 stay within one document."""
    ok = np.zeros(mask_len, bool)
    length = np.diff(off)
    good = np.flatnonzero(length >= reach)
    if len(good):
        d = np.zeros(mask_len + 1, np.int64)
        np.add.at(d, off[good], 1)
        np.add.at(d, off[good + 1] - reach + 1, -1)
        ok = np.cumsum(d[:-1]) > 0
    return ok
