"""Vectorised word splitting and hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are handled in runs of about this many bytes
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[key] = np.cumprod(run)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes each; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def pieces(batches: Iterable[pa.RecordBatch], text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of the column `text`."""
    for batch in batches:
        _, offsets = buffers(batch.column(text))
        for a, b in runs(offsets, most):
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes outside `blank`) and len+1 offsets of words by text."""
    solid = ~blank[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes: a polynomial over random byte codes, mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _POSITION[0])


def shingle_hashes(hashes: np.ndarray, by_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, in order, and their offsets by text. A text with fewer
    words has its whole sequence as one; one without words has none."""
    n = np.diff(by_text)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    span = len(hashes) - size + 1
    rolled = np.zeros(max(span, 0), np.uint64)
    for k in range(size):
        if span > 0:
            rolled += hashes[k : k + span] * _POSITION[k]
    owner = np.repeat(np.arange(len(count)), count)
    at = by_text[owner] + (np.arange(out[-1]) - out[owner])
    long = n[owner] >= size
    result = np.empty(out[-1], np.uint64)
    result[long] = rolled[at[long]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        w = hashes[by_text[i] : by_text[i + 1]]
        result[out[i]] = (w * _POSITION[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(result), out
