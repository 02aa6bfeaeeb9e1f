"""Vectorised text primitives over Arrow string buffers (NumPy only).

Texts are handled as the UTF-8 bytes that Arrow already holds; nothing here loops over
characters or words in Python. A batch is walked in chunks of bounded size so that a
worker's memory does not depend on the Arrow batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_WHITESPACE = np.zeros(256, dtype=bool)
_WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def _random_words(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed))


_BYTE_TABLE = _random_words(11, 256)
#: Where the two families of span hashes begin.
_FAMILIES = _random_words(1_000_003, 2)
#: Spans up to this size are hashed eight bytes at a time, all spans together; longer ones by BLAKE2.
LANES_BYTES = 64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES)
        _powers = np.full(size, _BASE, dtype=np.uint64)
        _inverses = np.full(size, _INVERSE, dtype=np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets (starting at 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all, or too many bytes for one
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` with about ``limit`` bytes each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the whitespace-separated words, and each row's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _WHITESPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    np.logical_not(space, out=space)
    starts = np.flatnonzero(space & before)
    ends = np.flatnonzero(space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p[i]``: the sum of ``table[byte j] * base**j`` for j < i (length n + 1), modulo 2**64.

    Only good for choosing places in texts: long strings made for it can collide whatever the base.
    """
    power, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_TABLE[data] * power[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; the two families are independent."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + _FAMILIES[family])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    open_ = np.flatnonzero((lengths > 0) & (lengths <= LANES_BYTES))
    done = 0
    while len(open_):
        left = np.minimum(lengths[open_] - done, 8)
        lane = lanes[starts[open_] + done] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
        out[open_] = mix(out[open_] ^ lane)
        done += 8
        open_ = open_[lengths[open_] > done]
    for i in np.flatnonzero(lengths > LANES_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([family])).digest(), "little")
    return out


_COEFFICIENTS = _random_words(77, 4096) | np.uint64(1)


def window_hash(symbols: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive symbols (fewer symbols: none)."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += symbols[j : j + n] * _COEFFICIENTS[(family * 1024 + j) % 4096]
    return mix(total)


def window_rows(first_word: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which window starts stay inside one row."""
    n = n_words - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return row[:n] == row[width - 1 :]


def covered(flags: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions inside any window that starts at a flagged position."""
    opened = np.zeros(size + 1, np.int32)
    np.cumsum(flags, out=opened[1 : len(flags) + 1])
    opened[len(flags) + 1 :] = opened[len(flags)]
    closed = opened[np.maximum(np.arange(size) - width + 1, 0)]
    return opened[1:] > closed


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` inside each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def binary_rows(items: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the bytes of ``items[cuts[i]:cuts[i + 1]]``."""
    items = np.ascontiguousarray(items)
    ends = (cuts.astype(np.int64) * items.dtype.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(items.tobytes())]).cast(pa.binary())


_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_FOLD).split()
