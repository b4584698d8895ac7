"""Arrow strings as numpy code-point arrays, a whole batch at a time.

Every function works on one flat array of code points and an offsets array
(row i is ``codes[offsets[i]:offsets[i + 1]]``); nothing is called per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: UTF-8 bytes handled at once; the numpy temporaries are some thirty times as large.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column holds about ``limit`` bytes in each part; a longer text stands alone."""
    text = batch.column(column)
    if batch.num_rows == 0:
        return
    ends = np.cumsum(_lengths(text))
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def _lengths(text: pa.Array) -> np.ndarray:
    return np.diff(_offsets(text))


def to_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and row offsets of a string array; null rows are empty."""
    if len(text) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    at = _offsets(text)
    data = text.buffers()[2]
    raw = memoryview(data)[at[0] : at[-1]] if data is not None else b""
    octets = np.frombuffer(raw, np.uint8)
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    if len(codes) == len(octets):
        return codes, at - at[0]
    heads = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
    return codes, heads[at - at[0]]


def widths(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def from_codes(codes: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The string array of flat code points; ``null`` marks null rows."""
    data = codes.astype(np.uint32, copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) == len(codes):
        at = offsets
    else:
        at = np.concatenate([[0], np.cumsum(widths(codes))])[offsets]
    bits, count = None, 0
    if null is not None and (count := int(null.sum())):
        bits = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    small = at[-1] < 1 << 31
    kind, width = (pa.string(), np.int32) if small else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [bits, pa.py_buffer(at.astype(width).tobytes()), pa.py_buffer(data)], count)


def nulls(text: pa.Array) -> np.ndarray:
    """Boolean array of the null rows."""
    return np.asarray(text.is_null())


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def expand(codes: np.ndarray, offsets: np.ndarray, length: np.ndarray, start: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point c by ``pool[start[c]:start[c] + length[c]]``; returns codes and offsets."""
    n = length[codes].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    if len(n) and n.max() == 1 and n.min() == 1:
        return pool[start[codes]], offsets
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    return pool[np.repeat(start[codes].astype(np.int64), n) + within], ends[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on uint64, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    #: Its inverse modulo 2**64.
    _INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_made: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept up to a few million for the next batch."""
    kept = _made.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, np.uint64)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        if len(kept) <= 1 << 22:
            _made[int(base)] = kept
    return kept[:n]


@cache
def letter_values() -> np.ndarray:
    """A random-looking 64-bit value for every code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def moving(values: np.ndarray, size: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``size`` successive values, in two passes whatever the size."""
    n = len(values)
    if n < size:
        return values[:0]
    low = np.iinfo(values.dtype).max if pick is np.minimum else np.iinfo(values.dtype).min
    blocks = -(-n // size)
    table = np.full(blocks * size, low, values.dtype)
    table[:n] = values
    table = table.reshape(blocks, size)
    ahead = pick.accumulate(table, axis=1).ravel()
    behind = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - size + 1], ahead[size - 1 : n])


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` successive values (uint64), by prefix sums modulo 2**64.

    The hash depends on the run alone, not on its place.
    """
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, n), dtype=np.uint64)])
        return mix((total[size:] - total[:-size]) * _powers(_INV, n - size + 1))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for many spans; it depends on the span's content and length alone."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, n), dtype=np.uint64)])
        return mix((total[end] - total[start]) * _powers(_INV, n + 1)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of true elements that stay within a row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(inside)]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


@cache
def letters_and_digits() -> np.ndarray:
    """True for code points that are letters or digits."""
    table = np.zeros(0x110000, bool)
    table[[c for c in (*range(0xD800), *range(0xE000, 0x323B0)) if chr(c).isalnum()]] = True
    return table


@cache
def lower_case() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, pool) for :func:`expand` to lower case."""
    n = 0x110000
    start, length, extra = np.arange(n, dtype=np.uint32), np.ones(n, np.uint8), []
    for c in (*range(0xD800), *range(0xE000, 0x1F000)):
        if (low := chr(c).lower()) != chr(c):
            if len(low) == 1:
                start[c] = ord(low)
            else:
                start[c], length[c] = n + len(extra), len(low)
                extra += map(ord, low)
    return length, start, np.concatenate([np.arange(n, dtype=np.uint32), np.array(extra, np.uint32)])


def lowered(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and offsets in lower case, character by character."""
    return expand(codes, offsets, *lower_case())


def word_hashes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words in lower case: maximal runs of letters and digits."""
    codes, offsets = lowered(codes, offsets)
    row, start, end = runs(letters_and_digits()[codes], offsets)
    return row, spans(letter_values()[codes], start, end)
