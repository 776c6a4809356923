"""Words and byte windows of Arrow text columns as numpy arrays.

Everything here works on one slice of one Arrow batch, a few megabytes of text,
inside a task. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20

_WORD = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one (a xor-shift and multiply finaliser)."""
    x = x ^ (x >> _WORD(32))
    x = x * _WORD(0xD6E8FEB86659FD93)
    x ^= x >> _WORD(32)
    x *= _WORD(0xD6E8FEB86659FD93)
    x ^= x >> _WORD(32)
    return x


#: A value for each byte, and one where A-Z count as a-z.
BYTE = mix(np.arange(1, 257, dtype=_WORD) * _WORD(_BASE))
_lower = np.arange(256)
_lower[65:91] += 32
LOWER = BYTE[_lower]

#: True where a byte belongs to a word: all but space, tab, line ends, vertical tab, form feed.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, *range(9, 14)]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_WORD)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, SLICE + 1)
        _powers[0] = _power(_BASE, size), _power(pow(_BASE, -1, 1 << 64), size)
    return _powers[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``limit`` bytes of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, null as empty, and the bounds of each."""
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values`` times the base's powers, from 0: one more than values."""
    out = np.zeros(len(values) + 1, dtype=_WORD)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch ``starts`` to ``ends``, from the running sums."""
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in. Words end with their row."""
    solid = SOLID[data]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before = np.empty_like(solid)
    if len(solid):
        before[0] = False
        before[1:] = solid[:-1]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    if len(solid):
        after[-1] = False
        after[:-1] = solid[1:]
    after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True):
    """``starts, ends, rows, hashes`` of every word; with ``lower`` A-Z count as a-z."""
    starts, ends, rows = words(data, bounds)
    return starts, ends, rows, spans_hash(sums((LOWER if lower else BYTE)[data]), starts, ends)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=_WORD)
    for k in range(width):
        out = mix(out * _WORD(_BASE) + hashes[k : k + n] + _WORD(k + 1)) if k == width - 1 else out * _WORD(_BASE) + hashes[k : k + n]
    return out


def whole(rows: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` neighbours lie in one row."""
    n = max(0, len(rows) - width + 1)
    return rows[:n] == rows[width - 1 : width - 1 + n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: ``counts[i]`` of the values, in order, for row i."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
