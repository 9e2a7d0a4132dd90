"""Vectorised scanning of Arrow text columns: words, word hashes and shingles of many documents at once.

Everything works on the UTF-8 bytes of a slice of documents (about ``SLICE_BYTES`` of text; a longer single
document makes a slice of its own), so the cost is a few numpy passes per byte and no Python object per word.
A word is a maximal run of ASCII digits, ASCII letters and non-ASCII characters, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_WORD = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_VALUE = mix(_codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.array([1], dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), np.uint64(_BASE))
        steps[0] = np.uint64(1)
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with at most ``limit`` bytes, or one row."""
    data, at = buffer_of(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def run_bounds(member: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True in ``member``; no run crosses a position in ``breaks``."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.unique(breaks[(breaks > 0) & (breaks < len(member))])
    before = np.empty_like(member)
    before[0] = False
    before[1:] = member[:-1]
    before[inner] = False
    after = np.empty_like(member)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    parts = _BYTE_VALUE[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64))


class Words:
    """Words of the documents of one slice: ``hashes``, byte ``starts`` and ``ends``, and ``first`` (word offsets by document)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lower = LOWER[data]
        self.starts, self.ends = run_bounds(IS_WORD[data], offsets)
        self.hashes = hash_runs(self.lower, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words (all words of a shorter, non-empty document) and offsets by document."""
        n = len(self.hashes)
        counts = np.diff(self.first)
        end = np.repeat(self.first[1:], counts)
        start = np.repeat(self.first[:-1], counts)
        at = np.arange(n)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            inside = at + j < end
            total += np.where(inside, self.hashes[np.minimum(at + j, n - 1)] if n else self.hashes, np.uint64(0)) * np.uint64(2 * j + 1) * np.uint64(0xD6E8FEB86659FD93)
        valid = (at + width <= end) | (at == start)
        offsets = np.concatenate([[0], np.cumsum(valid)])[self.first] if n else np.zeros(len(self.first), np.int64)
        return mix(total[valid]), offsets

    def normalised(self) -> tuple[bytes, np.ndarray]:
        """The words, each followed by one space, and byte offsets of the documents in them."""
        lengths = self.ends - self.starts
        out_first = np.cumsum(lengths + 1) - (lengths + 1)
        out = np.full(int((lengths + 1).sum()), 32, np.uint8)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(out_first, lengths) + place] = self.lower[np.repeat(self.starts, lengths) + place]
        bounds = np.append(out_first, len(out))[self.first]
        return out.tobytes(), bounds
