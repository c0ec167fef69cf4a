"""Words of Arrow text columns as numpy arrays of 64-bit hashes; runs inside Spark tasks.

The bytes of many texts are hashed together: a running sum of ``byte * P**position`` gives the hash of
any span by one subtraction and one multiplication, so no Python loop touches a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x5851F42D4C957F2D)
_P_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(keep: bytes | None) -> np.ndarray:
    """Value of each byte inside a word, with A-Z as a-z; 0 where the byte separates words."""
    out = np.arange(1, 257, dtype=np.uint16)
    out[65:91] = out[97:123]
    if keep is None:
        out[[32, 9, 10, 11, 12, 13]] = 0
    else:
        out[[b for b in range(128) if b not in keep]] = 0
    return out


#: Words between white space, and words of letters, digits and bytes of other scripts only.
SPACED = byte_table(None)
LETTERS = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, _P), np.full(size, _P_INVERSE)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


@dataclass
class Words:
    raw: np.ndarray  # bytes of the texts, one after another
    bounds: np.ndarray  # where each text starts in raw, with the end
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, with the end
    hash: np.ndarray
    sums: np.ndarray  # running sum of byte * P ** position

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * _power(len(self.raw))[1][start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's runs of k words, and the index of each text's first one, with the end.

        A text with fewer words gives its whole sequence as one; without words it gives none.
        """
        n, rows = np.diff(self.first), len(self.first) - 1
        here = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(here)])
        begin = np.repeat(self.first[:-1] - at[:-1], here) + np.arange(at[-1])
        last = np.repeat(self.first[1:], here)
        out = np.zeros(len(begin), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        with np.errstate(over="ignore"):
            for i in range(k):
                out = mix(out * _P + np.where(begin + i < last, padded[begin + i], np.uint64(0)) + np.uint64(i + 1))
        assert len(at) == rows + 1
        return out, at


def words(column: pa.Array, table: np.ndarray = SPACED) -> Words:
    """Words of every text; nulls have none."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    value = table[raw]
    inside = value > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(value * _power(len(raw))[0][: len(raw)], out=sums[1:])
    out = Words(raw, bounds, start, end, np.searchsorted(start, bounds), start, sums)
    out.hash = out.span(start, end)
    return out


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """The column in runs of about SLICE_BYTES of text, with the row where each starts."""
    chunks, row = column.chunks if isinstance(column, pa.ChunkedArray) else [column], 0
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        wide = pa.types.is_large_string(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
            yield row + lo, chunk.slice(lo, hi - lo)
            lo = hi
        row += len(chunk)
