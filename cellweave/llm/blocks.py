"""Vectorised text handling shared by the Python-side operators.

Texts reach Python as Arrow batches.  They are cut into blocks of a few megabytes (a single longer text is a block of
its own), and a block is tokenised and hashed with NumPy over its UTF-8 bytes, never word by word in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: UTF-8 bytes of text in one block.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def byte_class(*, lower: bool, alnum: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, replacement byte) tables of 256 entries.

    alnum: words are ASCII letters, digits and anything outside ASCII; else anything but the six ASCII space characters.
    lower: A-Z become a-z.
    """
    code = np.arange(256)
    folded = code.astype(np.uint8)
    if lower:
        upper = (code >= 0x41) & (code <= 0x5A)
        folded[upper] += 32
    if alnum:
        c = folded.astype(np.int64)
        word = ((c >= 0x30) & (c <= 0x39)) | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80)
        if not lower:
            word |= (code >= 0x41) & (code <= 0x5A)
    else:
        word = ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    return word, folded


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, _BASE_INV))
        if n > BLOCK_BYTES:  # of a very long text: not kept
            return up, down
        _powers = (up, down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a block: byte ranges in `data`, and `first[i]:first[i + 1]` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], *, salt: int = 0) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]], with a 64-bit hash of each word's folded bytes."""
    word, folded = table
    n = len(data)
    bounds = offsets.astype(np.int64)
    inside = word[data]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    starts = bounds[:-1]
    before[starts[starts < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    ends = bounds[1:] - 1
    after[ends[ends >= 0]] = False
    if n:
        after[n - 1] = False
    # an empty text must not cut the one around it: its "end" is the last byte before it, which ends a text anyway
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((folded[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    raw = (total[end] - total[start]) * down[start]
    hashed = mix(raw + np.uint64(salt) * _GRAM + (end - start).astype(np.uint64) * _BASE)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, first, hashed)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (along the first axis); the last k - 1 positions hold no gram and are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros((n, *hashes.shape[1:]), np.uint64)
    factor = 1
    for i in range(k - 1, -1, -1):
        total += hashes[i : i + n] * np.uint64(factor)
        factor = factor * int(_GRAM) & 0xFFFFFFFFFFFFFFFF
    return mix(total)


def within(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Of total - k + 1 gram positions, those whose k values lie in one text."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    if k > 1:
        for back in range(1, k):
            cut = first[1:-1] - back
            ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the position of the smallest, the rightmost of equal ones."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = values[:n].copy()
    where = np.arange(n)
    for i in range(1, w):
        other = values[i : i + n]
        better = other <= best
        best[better] = other[better]
        where[better] = np.flatnonzero(better) + i
    return where


@dataclass
class Block:
    """Rows of one Arrow batch; null texts are empty."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.batch.num_rows

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def texts(self) -> list[bytes]:
        raw, at = self.data.tobytes(), self.offsets.tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls have no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) and not pa.types.is_large_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return content, offsets - offsets[0]


def release() -> None:
    """Gives memory that a batch has left behind back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def released(made):
    """made, once what making it has left behind is given back."""
    release()
    return made


def cut(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of the batch, each of at most `most` bytes of text or of a single longer text."""
    data, offsets = _raw(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, n, row + 16384)
        yield Block(batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop
    release()

