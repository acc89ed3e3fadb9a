"""Vectorized word and line kernels over the UTF-8 buffers of Arrow string columns.

White space is the six ASCII characters 0x20 and 0x09-0x0D. They never occur inside a multi-byte UTF-8
sequence, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F | 5))
_SEED = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes(lane: int, lower: bool) -> np.ndarray:
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(_SEED[lane]))
    return codes[LOWER] if lower else codes


_CODES = {(lane, lower): _byte_codes(lane, lower) for lane in (0, 1) for lower in (False, True)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; B is odd, so the inverse exists."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        n = max(n, _SEGMENT + 1)
        base = int(_BASE[lane])
        up = np.full(n, np.uint64(base))
        down = np.full(n, np.uint64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 4 * _SEGMENT:
            _powers[lane] = have
    return have


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n+1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]; spans are in order and do not overlap.

    Prefix sums of code[byte] * B**i give every span's polynomial with one subtraction; the sums are taken over
    segments of bounded length, so temporaries do not grow with the batch.
    """
    out = np.empty(len(starts), np.uint64)
    codes = _CODES[lane, lower]
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = int(np.searchsorted(ends, base + _SEGMENT, side="right"))
        upto = max(upto, at + 1)
        stop = int(ends[upto - 1])
        up, down = _power_tables(lane, stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(codes[data[base:stop]] * up[: stop - base], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = upto
    return out


def window_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive entries; len(words) - n + 1 of them (none if shorter).

    Built by doubling: the hash of 2k entries comes from two hashes of k, so a window costs log n steps.
    """
    if len(words) < n or n < 1:
        return np.zeros(0, np.uint64)
    salt = np.uint64(0x8CB92BA72F3D8DD7 if lane == 0 else 0xA24BAED4963EE407)
    size, out = 1, words
    while size < n:
        step = min(size, n - size)
        m = len(words) - size - step + 1
        out = mix(out[:m] * salt + (out[step : step + m] ^ np.uint64(size + step)))
        size += step
    return out


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text comes alone and whole."""
    i = batch.schema.get_field_index(column)
    _, offsets = text_buffer(batch.column(i))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans to look at so that every different byte string is seen, and for each span its place among them.

    Spans are grouped by 128 bits of hash: by one lane, with the other lane checked; should they disagree, both
    lanes are compared.
    """
    one = span_hashes(data, starts, ends)
    two = span_hashes(data, starts, ends, lane=1)
    _, first, place = np.unique(one, return_index=True, return_inverse=True)
    if not np.array_equal(two[first][place], two):
        _, first, place = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, place.reshape(-1)


def gather_runs(begin: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that lay the runs ``which`` (each ``begin``, ``length``) end to end, and the ends of the laid runs."""
    n = length[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin[which] - (ends - n), n) + np.arange(total), ends


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow column over bytes laid end to end."""
    offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])
