"""Vectorised helpers over Arrow text columns, shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes in blocks of a few megabytes, so memory per task is bounded by the
block size or by one longest text. Words are maximal runs without the six ASCII separators
(space, tab, line feed, vertical tab, form feed, carriage return).

Word and n-gram hashes are 64-bit polynomial sums over random byte values, finished by a mixing
permutation. They are equal for equal byte sequences; unequal ones collide with chance 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 2**64))
_STEP = _U(0xD1342543DE82EF95)

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing permutation (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = _U(1)
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Block(NamedTuple):
    """Consecutive texts of a batch: rows lo..hi, their bytes, and the text bounds in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a block in order: byte bounds, row within the block, hash, and first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def byte_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds (n + 1) of a string column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a batch into blocks of at most ``limit`` bytes, or of one longer text."""
    data, bounds = byte_column(batch, name)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo])
        lo = hi


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, from per-byte values."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


class Spans(NamedTuple):
    """Byte bounds of words."""

    start: np.ndarray
    end: np.ndarray


def spans(data: np.ndarray, bounds: np.ndarray) -> Spans:
    """Words of texts that follow each other in ``data``."""
    n = len(data)
    inside = ~IS_SEPARATOR[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[:-1][bounds[:-1] < n]  # texts follow each other without a separator
    opens[edge] = inside[edge]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = inside[last]
    return Spans(np.flatnonzero(opens), np.flatnonzero(closes) + 1)


def words(block: Block, lower: bool = False) -> Words:
    data = LOWER[block.data] if lower else block.data
    start, end = spans(data, block.bounds)
    first = np.searchsorted(start, block.bounds)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(start, end, row, span_hash(BYTE_VALUE[data], start, end), first)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within a row, and the index of each one's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = w.hash[:n].copy()
    for j in range(1, k):
        out = out * _BASE + w.hash[j:n + j]
    at = np.flatnonzero(w.row[:n] == w.row[k - 1:])
    return mix(out[at]), at


def with_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys equal only for equal hashes of the same row."""
    return mix(hashes + (row.astype(np.uint64) + _U(1)) * _STEP)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs at least twice."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    if not len(twice):
        return np.zeros(len(keys), bool)
    top = np.zeros(1 << 16, bool)
    top[twice >> _U(48)] = True
    maybe = np.flatnonzero(top[keys >> _U(48)])
    out = np.zeros(len(keys), bool)
    out[maybe] = twice[np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)] == keys[maybe]
    return out


def row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags (or numbers) between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64 if flags.dtype == bool else flags.dtype)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
