"""Words of a batch of texts as numpy arrays: places, 64-bit hashes, hashes of word runs.

A word is a run of bytes other than space and 0x09-0x0D; UTF-8 keeps these bytes apart from all
others. Hashes come from prefix sums of byte values times powers of an odd number, so the hash of
any slice costs one subtraction and one product, and no loop runs over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
#: For chunks of which many arrays are held, and the smallest table of powers.
SMALL_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, of at least `n` places."""
    size = max(SMALL_CHUNK, 1 << max(n, 1).bit_length())
    if size not in _powers:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.setdefault(size, ())
            _powers[size] += (np.multiply.accumulate(row),)
    return _powers[size]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of groups of texts of about `most` bytes.

    A null is an empty text. A text longer than `most` comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that no text's end crosses: starts, ends and the text of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Slices:
    """Hashes of slices of one chunk of bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices, by blocks of whole slices so that memory follows CHUNK_BYTES.

    A slice longer than a block is hashed by itself.
    """
    if len(data) <= 2 * CHUNK_BYTES:
        return Slices(data).hash(starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        if ends[i] - base > CHUNK_BYTES:
            digest = hashlib.blake2b(data[base:ends[i]].tobytes(), digest_size=8).digest()
            out[i], j = int.from_bytes(digest, "little"), i + 1
        else:
            out[i:j] = Slices(data[base:ends[j - 1]]).hash(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def runs(hashes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and their first words' places."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0xD1342543DE82EF95)
        total += hashes[k:k + n]
    keep = np.flatnonzero(texts[:n] == texts[size - 1:])
    return mix(total[keep]), keep


def repeated(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more in its text, and is it a later occurrence?"""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(keys + texts.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later_sorted = np.concatenate([[False], same])
    any_sorted = later_sorted | np.concatenate([same, [False]])
    again, later = np.empty(n, bool), np.empty(n, bool)
    again[order], later[order] = any_sorted, later_sorted
    return again, later
