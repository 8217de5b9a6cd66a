"""Recompression of word sequences: rounds that name runs and pairs of symbols.

Every round replaces maximal runs of one symbol by one name, and then each pair of a left and a right
symbol by one name; the side is a hash bit of the symbol. Names are 64-bit hashes of what they stand
for, so the same content has the same name in every document without a dictionary.

Each symbol also carries its context: the words that its parse depends on. Wherever these words occur,
the same symbol occurs. So if a sequence of words occurs twice, every symbol whose context lies inside
it occurs twice as well, and a symbol that occurs once rules out all sequences around its context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .texts import constants, mix

ROUNDS = 6
#: Pairs are joined up to this many words. Longer symbols come from runs only.
LONGEST = 10

_SIDE = constants(41, 64)
_RUN, _LEFT, _RIGHT = (np.uint64(int(c) | 1) for c in constants(42, 3))


@dataclass
class Symbols:
    """Symbols of texts one after another: name, words [start, end), context words [low, high)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, keep: np.ndarray) -> Symbols:
        return Symbols(self.name[keep], self.start[keep], self.end[keep], self.low[keep], self.high[keep])


def _runs(s: Symbols, words: np.ndarray, joined: np.ndarray) -> Symbols:
    """One symbol for each maximal run. joined[k]: symbol k+1 is of the same text as symbol k."""
    same = joined & (s.name[1:] == s.name[:-1])
    # That neighbours differ is seen from the nearest word if that differs, else from the neighbour.
    a, b = np.flatnonzero(joined & ~same), np.flatnonzero(joined & ~same) + 1
    right = np.where(words[s.start[b]] != words[s.start[a]], s.start[b] + 1, s.high[b])
    left = np.where(words[s.end[a] - 1] != words[s.end[b] - 1], s.end[a] - 1, s.low[a])
    high, low = s.high.copy(), s.low.copy()
    high[a] = np.maximum(high[a], right)
    low[b] = np.minimum(low[b], left)
    ends = np.flatnonzero(~joined)
    high[ends] = np.maximum(high[ends], s.end[ends] + 1)  # the text's end: no window sees beyond it
    low[ends + 1] = np.minimum(low[ends + 1], s.start[ends + 1] - 1)
    high[-1] = max(high[-1], s.end[-1] + 1)
    low[0] = -1
    if not same.any():
        return Symbols(s.name, s.start, s.end, low, high)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(first, len(s.name)))
    name = s.name[first]
    long = count > 1
    name[long] = mix(name[long] * _RUN + count[long].astype(np.uint64))
    last = first + count - 1
    return Symbols(
        name, s.start[first], s.end[last], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    )


def _pairs(s: Symbols, joined: np.ndarray, salt: np.uint64) -> Symbols:
    """One symbol for each left symbol followed by a right one."""
    size = s.end - s.start
    left = (mix(s.name ^ salt) >> np.uint64(63)).astype(bool)
    open_ = size < LONGEST
    looks_right = open_ & left
    looks_left = open_ & ~left
    fits = joined & looks_right[:-1] & looks_left[1:] & (size[1:] + size[:-1] <= LONGEST)
    low, high = s.low.copy(), s.high.copy()
    # What a symbol looked at belongs to its context, joined or not; so does a text's edge.
    np.maximum(high[:-1], np.where(looks_right[:-1] & joined, s.high[1:], 0), out=high[:-1])
    np.minimum(low[:-1], np.where(looks_right[:-1] & joined, s.low[1:], low[:-1]), out=low[:-1])
    np.minimum(low[1:], np.where(looks_left[1:] & joined, s.low[:-1], low[1:]), out=low[1:])
    np.maximum(high[1:], np.where(looks_left[1:] & joined, s.high[:-1], 0), out=high[1:])
    taken = np.flatnonzero(fits)
    name, end = s.name.copy(), s.end.copy()
    name[taken] = mix(s.name[taken] * _LEFT + mix(s.name[taken + 1] * _RIGHT))
    end[taken] = s.end[taken + 1]
    low[taken] = np.minimum(s.low[taken], s.low[taken + 1])
    high[taken] = np.maximum(s.high[taken], s.high[taken + 1])
    keep = np.ones(len(name), dtype=bool)
    keep[taken + 1] = False
    return Symbols(name, s.start, end, low, high).take(keep)


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """The symbols of texts after all rounds; text k has the words bounds[k]..bounds[k+1]."""
    places = np.arange(len(words))
    s = Symbols(words, places, places + 1, places, places + 1)
    if not len(words):
        return s
    opens = np.zeros(len(words) + 1, dtype=bool)
    opens[bounds] = True
    for k in range(rounds):
        s = _runs(s, words, ~opens[s.start[1:]])
        s = _pairs(s, ~opens[s.start[1:]], _SIDE[k])
    return s
