"""Words and hashes of many texts at once, computed with numpy on the UTF-8 bytes of an Arrow batch.

White space is the set ``\\x20`` and ``\\x09``-``\\x0D``; none of these bytes occurs inside another UTF-8 character,
so words can be cut on bytes. All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # a slice holds at least one text; its arrays take some fifty bytes per byte of text

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (multiply, shift, multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


BYTE_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * _MUL)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class _Powers:
    """Powers of the base and of its inverse, made longer when a longer slice comes."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = U64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE, U64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, inverse, U64)]))
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Slice:
    """Some texts one after another: text ``k`` is ``data[starts[k]:ends[k]]`` and belongs to row ``first + k``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k]:self.ends[k]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of strings (null: empty) into runs of rows of about ``most`` bytes."""
    if len(texts) == 0:
        return
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, at, raw = texts.buffers()  # the bytes themselves are not copied
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        low = at[row]
        yield Slice(data[low:at[stop]], at[row:stop] - low, at[row + 1:stop + 1] - low, row)
        row = stop


@dataclass
class Words:
    """Words of a slice: byte ranges, the text each belongs to, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more entry than texts

    def __len__(self) -> int:
        return len(self.start)


def words(part: Slice) -> Words:
    n = len(part.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(part) + 1, np.int64))
    ink = ~WHITE[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.starts] = True
    edge[n] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:n]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(start, np.append(part.starts, n))
    return Words(start, end, np.repeat(np.arange(len(part)), np.diff(first)), first)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A hash of each byte range that depends on its bytes alone."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(codes[data] * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * _MUL)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours; the caller drops runs that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for k in range(size):
            out = out * _BASE + hashes[k:n + k]
        return mix(out)
