"""Whole texts as byte arrays: words, 64-bit word hashes and n-gram hashes without a Python loop per word.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 is the pattern
``[^\\x20\\x09-\\x0D]+`` on characters.  A text of any length is hashed in slices cut between words, so
memory beyond 24 bytes a word is bounded by ``SLICE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BATCH = 1 << 22
U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 5
_PINV = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(pow(base, k, 2**64))
            k += m
    return out


_tables: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _tables.get((base, 0))
    if have is None or len(have) < n:
        have = _tables[base, 0] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h + U((salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def groups(offsets: np.ndarray, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together (a longer text is a run of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (n + 1 entries)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= cut[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= cut[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    out = np.empty(len(starts), U)
    table = _BYTE[LOWER] if lower else _BYTE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            n = int(ends[j - 1] - base)
            c = np.empty(n + 1, U)
            c[0] = 0
            np.cumsum(table[data[base : base + n]] * powers(_P, n), out=c[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((c[e] - c[s]) * powers(_PINV, n + 1)[s] + (e - s).astype(U))
            i = j
    return out


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive entries of ``h`` (crossing texts too: mask those by text)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc = mix(h, salt) if salt else h
        out = np.zeros(m, U)
        p = _P if not salt else (0xD1342543DE82EF95 | 5)
        for j in range(n):
            out += acc[j : j + m] * U(pow(p, j, 2**64))
        return mix(out, salt + n)


def one_hash(h: np.ndarray, salt: int = 0) -> int:
    """Hash of a whole sequence with its length."""
    with np.errstate(over="ignore"):
        a = mix(h, salt) if salt else h
        s = U(0) if not len(a) else (a * powers(_P, len(a))).sum(dtype=U)
        return int(mix(np.array([s + U(len(a))], U), 77 + salt)[0])
