"""Words of Arrow text columns as numpy arrays, hashed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes taken through numpy at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_VALUES = _random.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Chunk(NamedTuple):
    """Some texts end to end: their bytes, their limits, and their place in the batch."""

    first: int
    data: np.ndarray
    limits: np.ndarray

    @property
    def n(self) -> int:
        return len(self.limits) - 1


class Words(NamedTuple):
    """Word limits in a chunk; word ``i`` of text ``t`` has ``bounds[t] <= i < bounds[t + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column, whole, in chunks of about ``size`` bytes; a null text is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(limits, limits[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(first, raw[limits[first] : limits[last]], limits[first : last + 1] - limits[first])
        first = last


def word_limits(chunk: Chunk, apart: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes not marked in ``apart`` (space and 0x09 to 0x0D), none crossing two texts."""
    inside = ~apart[chunk.data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    size = len(chunk.data)
    cuts = chunk.limits[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first = np.flatnonzero(starts)
    return Words(first, np.flatnonzero(ends) + 1, np.searchsorted(first, chunk.limits))


def word_hashes(data: np.ndarray, words: Words, keep: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``keep``, of its bytes where that is true."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(int(lengths.sum())) - np.repeat(heads - words.starts, lengths)
    if keep is None:
        place = at - np.repeat(words.starts, lengths)
        sizes = lengths
    else:
        kept = keep[at]
        before = np.cumsum(kept) - kept
        place = before - np.repeat(before[heads], lengths)
        sizes = np.add.reduceat(kept.astype(np.int64), heads)
    value = BYTE_VALUES[data[at]] * PLACE_VALUES[place & 4095]
    if keep is not None:
        value = np.where(kept, value, np.uint64(0))
    wide = place > 4095
    if wide.any():
        value = np.where(wide, mix(value + place.astype(np.uint64)), value)
    return mix(np.add.reduceat(value, heads) + sizes.astype(np.uint64))


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    owner = words.owner
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[at]), at


def sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sum of the values between each two limits, as 64-bit integers or doubles."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return np.diff(total[limits])


def text_sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sum of doubles between each two limits, each added up on its own, so that neighbours don't change it."""
    out = np.zeros(len(limits) - 1)
    full = np.flatnonzero(np.diff(limits))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), limits[full])
    return out


def line_limits(chunk: Chunk) -> Words:
    """The lines of each text, split at line feeds, as limits without the feeds."""
    feeds = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([feeds + 1, chunk.limits[:-1]]), kind="stable")
    ends = np.sort(np.concatenate([feeds, chunk.limits[1:]]), kind="stable")
    owned = np.searchsorted(feeds, chunk.limits) + np.arange(chunk.n + 1)
    return Words(starts, ends, owned)
