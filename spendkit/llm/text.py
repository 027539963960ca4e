"""Words and hashes of many texts at once, over the bytes of Arrow batches.

Every function works on a slice of a batch: `data`, the UTF-8 bytes of some whole texts, and `offsets`, where
each text begins in them. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ np.uint64(salt) if salt else x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    held = _powers.get(int(base))
    if held is None or len(held) <= n:
        steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        held = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:  # a single huge text does not leave a huge table behind
            _powers[int(base)] = held
    return held[: n + 1]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) over a string column, null as empty; about `most` bytes, a text at least."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def byte_tables(separators: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte with A-Z lower-cased, whether it belongs to a word); all bytes of non-ASCII characters do."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    inside[[ord(c) for c in separators]] = False
    return lower, inside


#: Words `[^\x20\x09-\x0D]+`.
BLANK = byte_tables("\x20\x09\x0a\x0b\x0c\x0d")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing, so A-Z are letters.
ALNUM = byte_tables("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


@dataclass
class Words:
    """The words of some texts: where they begin and end in `low`, their hashes, and the first word of each text."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self, begin: int, end: int) -> list[bytes]:
        return [self.low[self.starts[i] : self.ends[i]].tobytes() for i in range(begin, end)]


def words(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> Words:
    lower, word_byte = tables
    low, inside = lower[data], word_byte[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(low, none, none, none.view(np.uint64), np.zeros(len(offsets), np.int64))
    begins, stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[offsets] = True  # a word does not go on into the next text
    stops[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (begins[:n] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (stops[1:] | ~after)) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_UNBASE, n)[starts])
    return Words(low, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; entry i begins at word i. The last k - 1 have no meaning across the end."""
    n = len(hashes)
    out = hashes.copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out[: n - j] += hashes[j:]
    return mix(out, k)


def rolling(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [begin, end), whatever their lengths."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes))[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * _power(_UNBASE, len(hashes))[begins])
