"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word's hash is a polynomial of its bytes modulo 2**64, from prefix sums, finished by a 64-bit mixer.
Bytes of characters beyond ASCII belong to words; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes worked on at once, in some 50 times as much memory; a longer text is a chunk of its own

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
OTHERS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Words(NamedTuple):
    doc: np.ndarray  # of each word: which text
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray  # prefix sums, for hash_of()


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a well-known 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; null counts as empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def hash_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(1, np.uint64))
    inside = ~separators[buf]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~first
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~first[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, _ = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, hash_of(sums, start, end), sums)


def joined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = mix(out * _P + hashes[i : i + n] + np.uint64(i + 1)) if n > 0 else out
    return out
