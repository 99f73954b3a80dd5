"""Word and shingle hashes of whole texts, computed on Arrow buffers with numpy.

All hashes are 64-bit and depend on the text alone. A batch is handled in pieces of
about ``PIECE`` bytes (one text at least), so memory follows the longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

_U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_M_INVERSE = pow(_M, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the information of each 64-bit value over all its bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_M) + _U(seed * 0x632BE59BD9B4E019 % (1 << 64)))


def _byte_values(lower_ascii: bool) -> np.ndarray:
    values = numbers(256, 11)
    if lower_ascii:
        values[65:91] = values[97:123]
    return values


_EXACT, _FOLDED = _byte_values(False), _byte_values(True)
#: The six ASCII white-space characters.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * PIECE)
        _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _M, _U)]))
        _inverses = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _M_INVERSE, _U)]))
    return _powers, _inverses


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text bounds within these bytes) of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def words(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, fold: bool = True):
    """Hash of every word, and for each text the index of its first word (one entry more than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    apart = separators[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = apart[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = apart[1:]
    last[inner - 1] = True
    inside = ~apart
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    powers, inverses = _tables(n)
    total = np.zeros(n + 1, _U)
    np.cumsum((_FOLDED if fold else _EXACT)[raw] * powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverses[starts])
    return hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one text, in order; a shorter text is one run, no words none."""
    n = len(hashes)
    width = min(n, size)
    if not n:
        return hashes
    out = np.zeros(n - width + 1, _U)
    for k in range(width):
        out = (out + hashes[k : k + len(out)]) * _STEP + _U(k + 1)
    return mix(out)
