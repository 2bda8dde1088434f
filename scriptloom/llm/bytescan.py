"""Word splitting and hashing of Arrow string columns in numpy, without a Python object for each word.

Words are runs of bytes that a 256-entry table marks; UTF-8 keeps ASCII
delimiters out of longer characters, so runs never cut a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space of the contracts: \x20 and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
NOT_WHITE = ~WHITE
#: Rows copied at a time.
ROWS = 512

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random value for each byte, and the same with A-Z taken as a-z.
EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, U64)
        step[0] = 1
        have = _powers[name] = np.cumprod(step, dtype=U64)
    return have


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``most`` bytes; a null is an empty text."""
    whole = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    chunks = (c.slice(i, ROWS) for c in whole for i in range(0, len(c), ROWS))
    row = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        _, off, raw = chunk.buffers()
        offsets = np.frombuffer(off, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            j = min(j, len(chunk))
            yield row + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row += len(chunk)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``inside`` bytes, and the row it is in; runs end with their row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mask = inside[data]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[cut] = mask[cut]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[cut - 1] = mask[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values[data] * _power("up", _BASE, n)[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, n)[starts]
    return mix(raw ^ ((ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D)))


def shingles(word: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their rows; a row of fewer words, but not none, has its whole sequence as one."""
    factor = mix(np.arange(11, 11 + k, dtype=U64)) | U64(1)
    per_row = np.bincount(row, minlength=rows)
    n = len(word) - k + 1
    if n > 0:
        total = np.zeros(n, U64)
        for j in range(k):
            total += word[j : j + n] * factor[j]
        same = row[:n] == row[k - 1 :]
        found, at = mix(total[same] + U64(k)), row[:n][same]
    else:
        found, at = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        first = np.cumsum(per_row) - per_row
        extra = np.array([int(np.sum(word[first[i] : first[i] + per_row[i]] * factor[: per_row[i]], dtype=U64)) for i in short], U64)
        found, at = np.concatenate([found, mix(extra + per_row[short].astype(U64))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        found, at = found[order], at[order]
    return found, at


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)
