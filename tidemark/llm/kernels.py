"""Vectorised byte kernels over concatenated texts (numpy only)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit coefficient for every byte; the second table reads A-Z as a-z.
COEF = _splitmix(256, 11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
COEF_LOWER = COEF[LOWER]
#: ``[\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        run = np.full(size, _INVERSE if inverse else _BASE, U)
        run[0] = 1
        have = _POWERS[inverse] = np.cumprod(run, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def prefix_hash(data: np.ndarray, coef: np.ndarray = COEF) -> np.ndarray:
    """Prefix sums of ``coef[byte] * base**i`` modulo 2**64; one longer than ``data``."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(coef[data] * powers(len(data)), dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``data[start:end]``, the same wherever the bytes stand."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``data[i:i+k]``."""
    n = len(prefix) - 1
    if n < k:
        return np.zeros(0, U)
    return mix((prefix[k:] - prefix[:-k]) * powers(n - k + 1, inverse=True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first byte, code point and number of bytes of every character beyond ASCII in valid UTF-8."""
    lead = np.flatnonzero(data >= 0xC0)
    wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    length = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = wide[lead] & (0xFF >> (length + 1))
    for j in range(1, 4):
        point = np.where(length > j, (point << 6) | (wide[lead + np.minimum(j, length - 1)] & 63), point)
    return lead, np.minimum(point, 0x10FFFF), length


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` in each text, and how many words precede each text.

    ``off`` holds the texts' offsets into ``data`` (first 0, last ``len(data)``).
    """
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty_like(solid)
    if len(data):
        before[0] = True
        before[1:] = ~solid[:-1]
    after = np.empty_like(solid)
    if len(data):
        after[-1] = True
        after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingles(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` successive words of a text and their text's index; shorter texts give one."""
    counts = np.diff(first)
    out_n = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    doc = np.repeat(np.arange(len(counts)), out_n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(out_n) - out_n, out_n) + np.repeat(first[:-1], out_n)
    span = np.minimum(n, counts)[doc]
    total = np.zeros(len(doc), U)
    mult = 1
    for j in range(n):
        mult = mult * _BASE % (1 << 64)
        use = j < span
        total[use] += word_hash[at[use] + j] * U(mult)
    return mix(total + span.astype(U)), doc
