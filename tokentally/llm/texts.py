"""Words of whole Arrow text columns and their 64-bit hashes, computed in numpy without per-word Python.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these bytes inside
a character, so the bytes need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Between words without punctuation: all of ASCII but digits and letters.
PUNCTUATION = np.ones(256, dtype=bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z"), ("\x80", "\xff")):
    PUNCTUATION[ord(_first) : ord(_last) + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit over the result."""
    x = values.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(seed: int, count: int) -> np.ndarray:
    """So many fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept as far as they were needed."""

    def __init__(self, seed: int):
        self.base = int(constants(seed, 1)[0]) | 1
        self.up = self.down = np.ones(1, dtype=_U)

    def to(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = count + count // 8
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))
                for base in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up, self.down


_BYTES = constants(11, 256)
_POWERS = Powers(12)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes."""
    up, down = _POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def rolling_hash(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values; empty if there are fewer."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=_U)
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:count]) * down[:count])


@dataclass
class Chunk:
    """Some whole texts: rows first..first+n of the batch, text k is data[offsets[k]:offsets[k+1]].

    Text k has the words bounds[k]..bounds[k+1]; word i is data[starts[i]:ends[i]].
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def text_parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, places, content = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(content, dtype=np.uint8) if content else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def chunks(
    column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES, between: np.ndarray = SPACE
) -> Iterator[Chunk]:
    """The words of all texts; with `lower`, A-Z are lower-cased. `between` marks the bytes between words."""
    for first, data, offsets in text_parts(column, limit):
        if lower:
            data = LOWER[data]
        full = ~between[data]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before = np.concatenate([[False], full[:-1]]) if len(full) else full
        after = np.concatenate([full[1:], [False]]) if len(full) else full
        before[edges] = False
        after[edges - 1] = False
        starts = np.flatnonzero(full & ~before)
        ends = np.flatnonzero(full & ~after) + 1
        yield Chunk(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... (counts[0] of them), begins[1], ...: indexes of many runs."""
    total = int(counts.sum())
    shift = np.cumsum(counts) - counts
    return np.repeat(begins - shift, counts) + np.arange(total)
