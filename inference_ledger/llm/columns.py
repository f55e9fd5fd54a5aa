"""Arrow string columns as flat byte arrays, and hashes over ranges of them.

Everything here works on one bounded slice of an Arrow batch inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, at, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, by: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of at most ``most`` bytes in column ``by`` (one row at least)."""
    column = batch.column(batch.schema.get_field_index(by))
    _, offsets = flat_bytes(column)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Copy with A-Z (and nothing else) in lower case."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of maximal runs of word bytes that stay in one row."""
    before = np.empty(len(is_word), bool)
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < len(is_word)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(len(is_word), bool)
    after[:-1] = is_word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False      # an empty row's last byte is its predecessor's
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def ranges_within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, concatenated."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


# fixed values: the primes of the XXH64 definition
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, value):
    return _rotl(acc + value * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every range ``data[start:start + length]``, all ranges side by side."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))    # eight bytes at every position
    seed = np.uint64(seed)
    pos, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        acc = np.full(len(pos), seed + _P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            lanes = [np.full(len(long), s, np.uint64) for s in
                     (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            p, r, on = pos[long], left[long], np.arange(len(long))
            while len(on):
                for k in range(4):
                    lanes[k][on] = _lane(lanes[k][on], words[p[on] + 8 * k])
                p[on] += 32
                r[on] -= 32
                on = on[r[on] >= 32]
            got = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                got = (got ^ _lane(np.uint64(0), lane)) * _P1 + _P4
            acc[long] = got
            pos[long], left[long] = p, r
        acc += length.astype(np.uint64)
        on = np.flatnonzero(left >= 8)
        while len(on):
            acc[on] = _rotl(acc[on] ^ _lane(np.uint64(0), words[pos[on]]), 27) * _P1 + _P4
            pos[on] += 8
            left[on] -= 8
            on = on[left[on] >= 8]
        on = np.flatnonzero(left >= 4)
        if len(on):
            four = words[pos[on]] & np.uint64(0xFFFFFFFF)
            acc[on] = _rotl(acc[on] ^ (four * _P1), 23) * _P2 + _P3
            pos[on] += 4
            left[on] -= 4
        on = np.flatnonzero(left >= 1)
        while len(on):
            acc[on] = _rotl(acc[on] ^ (padded[pos[on]].astype(np.uint64) * _P5), 11) * _P1
            pos[on] += 1
            left[on] -= 1
            on = on[left[on] >= 1]
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc
