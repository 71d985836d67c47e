"""Vectorised word work on the UTF-8 bytes of an Arrow string column.

Words are runs of ``[^\\x20\\x09-\\x0D]``. All of these bytes are ASCII, so segmentation on bytes equals
segmentation on code points. A word's hash takes in eight bytes at a time, each through a full 64-bit mix, for all words side by side, so that
no Python object is made per word. Words of one length that differ in one such run of eight bytes have different hashes; no sum or polynomial is
involved whose terms could cancel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer document is worked on alone.
BLOCK_BYTES = 1 << 20

#: Words longer than this are hashed one by one.
LONG = 256

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of documents with at most ``most`` bytes, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document (n + 1 entries).

    ``offsets`` start at 0 and end at ``len(data)``.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = edge[edge > 0] - 1
    stops[last] = solid[last]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; different seeds give independent ones."""
    length = ends - starts
    out = mix64(length.astype(_U) ^ mix64(np.array([seed + 1], _U)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest(), "little")
    some = np.flatnonzero((length <= LONG) & (length > 0))
    at, left = starts[some], length[some]
    while len(some):
        value = eight[at]
        part = np.flatnonzero(left < 8)
        value[part] &= (_U(1) << (8 * left[part]).astype(_U)) - _U(1)
        out[some] = mix64(out[some] * _ODD ^ value)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
