"""Vectorised word and shingle hashing over the byte buffers of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit
polynomials modulo 2**64 with a final mix; callers that decide something by equality alone
take two of them with different bases (128 bits). Polynomials modulo a power of two have
collisions that hold for every base, the shortest between words of 1024 characters (a Thue-Morse word
and its complement), so words of 512 bytes and more are hashed with BLAKE2b instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
WINDOW_A = 0xD6E8FEB86659FD93
WINDOW_B = 0xA0761D6478BD642F
PIECE = 1 << 19
LONG = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1024), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per text, the index of its first word (one entry more)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, worked out in pieces so that memory stays bounded."""
    out = np.empty(len(starts), dtype=np.uint64)
    back, i = inverse(base), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        at, to = int(starts[i]), int(ends[j - 1])
        piece = data[at:to]
        if lower:
            piece = _LOWER[piece]
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(base, to - at), out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * powers(back, to - at)[s] + (e - s).astype(np.uint64)
        i = j
    out = mix(out)
    for k in np.flatnonzero(ends - starts >= LONG):
        word = data[starts[k] : ends[k]]
        word = (_LOWER[word] if lower else word).tobytes()
        out[k] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=base.to_bytes(8, "little")).digest(), "little"))
    return out


def windows(word_hashes: np.ndarray, size: int, base: int = WINDOW_A) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries (len - size + 1 of them)."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, dtype=np.uint64), 1 << 18
    back = inverse(base)
    for i in range(0, n, step):
        j = min(n, i + step)
        part = word_hashes[i : j + size - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        out[i:j] = (total[size : size + j - i] - total[: j - i]) * powers(back, j - i)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
