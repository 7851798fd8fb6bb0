"""Vectorised word hashing of Arrow string columns: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = U(0xD6E8FEB86659FD93)
_Q_INV = U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that no normalised word holds: all of ASCII but its letters.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = True
NO_LETTER[65:91] = NO_LETTER[97:123] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them; grown by doubling and kept."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.full(size, base, U)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got, dtype=U)
        if size <= 1 << 23:
            _powers[int(base)] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """For each [start, end): the sum of values[start + k] * base**k modulo 2**64."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * _power(base, len(values) + 1)[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(inverse, len(values) + 1)[starts]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20, most_rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about most_bytes of the column's text and at most most_rows rows; at least one row each."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, done + most_bytes, "right"))
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def words(raw: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word. `offsets` also end words: no word spans two texts."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ~ends_word[raw]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inner[cuts]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    last[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        return mix(ranges(raw + U(1), starts, ends, _P, _P_INV) + (ends - starts).astype(U)), starts, ends


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of each distinct shingle of `width` words of each text, sorted by row and hash. Hashes have 52
    bits. A text of fewer words, but one, is a single shingle. At most 4096 rows."""
    assert len(column) <= 4096
    raw, offsets = text_bytes(column)
    hashes, starts, _ = words(raw, offsets)
    begin = np.searchsorted(starts, offsets)  # words of row i: begin[i] .. begin[i + 1]
    count = np.diff(begin)
    row_of = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            acc = np.zeros(len(hashes) - width + 1, U)
            for k in range(width):
                acc += hashes[k : len(hashes) - width + 1 + k] * _power(_Q, width)[k]
            own = row_of[: len(acc)] == row_of[width - 1 :]
            acc, rows = acc[own], row_of[: len(own)][own]
        else:
            acc, rows = np.zeros(0, U), np.zeros(0, np.int64)
        small = np.flatnonzero((count > 0) & (count < width))
        if len(small):
            acc = np.concatenate([acc, ranges(hashes, begin[small], begin[small + 1], _Q, _Q_INV) + count[small].astype(U)])
            rows = np.concatenate([rows, small])
        key = (rows.astype(U) << U(52)) | (mix(acc) >> U(12))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> U(52)).astype(np.int64), key & U((1 << 52) - 1), times
