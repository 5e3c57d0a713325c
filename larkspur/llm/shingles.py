"""Word shingles as 64-bit fingerprints, by whole arrays of bytes.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r of the UTF-8 text with A-Z lower-cased. A word's
fingerprint is a polynomial over a table of 256 random odd numbers, finished by a mixer; words beyond LONG bytes take xxh64. A shingle's is a
chain over its words' fingerprints. Texts are processed in pieces of about PIECE bytes, cut at white space, so the working memory
beyond the fingerprints themselves (8 bytes a word) doesn't grow with a text.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash

SIZE = 5
PIECE = 1 << 20
LONG = 64
_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE)) | _U(1)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _piece_hashes(raw: bytes) -> np.ndarray:
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(max(17, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)])])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0])
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes


def word_hashes(raw: bytes) -> np.ndarray:
    if len(raw) <= 2 * PIECE:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        cut = _SPACES.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def _chain(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    n = len(words) - size + 1
    x = _mix(words[:n] + _U(salt))
    for k in range(1, size):
        x = _mix(x * _U(_BASE) + words[k : k + n])
    return x


def all_shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The shingles in order; of fewer words the whole sequence; of none an empty array."""
    words = word_hashes(text.encode()) if text else np.empty(0, np.uint64)
    if len(words) == 0:
        return words
    return _chain(words, size, 0) if len(words) >= size else _chain(words, len(words), len(words))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(all_shingles(text, size))


def parity(x: np.ndarray) -> bytes:
    """A bitmap with one to two bits for each of the distinct shingles: a bit tells whether an odd number of them falls on it."""
    width = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def parity_words(x: np.ndarray, n: int) -> np.ndarray:
    """The parity bitmap of n * 64 bits, n a power of two, as n longs, over the upper bits, which no wider bitmap shares."""
    bits = np.bincount((x >> np.uint64(64 - (n * 64 - 1).bit_length())).astype(np.int64), minlength=n * 64) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their bitmaps; the wider one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
