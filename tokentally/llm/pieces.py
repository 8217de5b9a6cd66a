"""Byte-level BPE of whole texts with the tokenizers library, each distinct piece encoded once per task.

Byte-level BPE first splits a text into pieces (a word with its space, a number, punctuation, white
space) and then encodes each piece on its own. Splitting is done here in numpy over all texts of a
batch, by the rule the vocabulary's pre-tokenizer states; the library encodes the pieces that this
task has not met yet. Texts with characters whose class may differ between Unicode versions, or
beyond the basic plane, are encoded whole by the library.
"""

from __future__ import annotations

import unicodedata
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .texts import ragged, spans_hash, text_parts

#: Distinct pieces a task remembers; beyond, it forgets all and starts again.
REMEMBERED = 500_000
#: Bytes of text split at once.
SPLIT_BYTES = 1 << 20

LETTER, NUMBER, WHITE, OTHER, UNSURE = range(5)

# The endings that the vocabulary's pre-tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    """The class of each character of the basic plane; UNSURE if it changed since Unicode 3.2."""

    def of(data, char: str) -> int:
        kind = data.category(char)
        return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER

    old, new = unicodedata.ucd_3_2_0, unicodedata
    table = np.full(0x10000, UNSURE, dtype=np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if old.category(char) != "Cn" and of(old, char) == of(new, char):
            table[code] = of(new, char)
    table[0xD800:0xE000] = UNSURE
    table[0x180E] = table[0x200B] = UNSURE  # white space in some versions only
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]] = WHITE
    table[[0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return table


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and code point of each character; beyond the basic plane the code is 0xFFFF."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    codes = lead.copy()
    two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
    at = starts[two]
    codes[two] = (lead[two] & 0x1F) << 6 | padded[at + 1] & 0x3F
    three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
    at = starts[three]
    tail = (padded[at + 1] & 0x3F).astype(np.uint32) << 6 | padded[at + 2] & 0x3F
    codes[three] = (lead[three] & 0x0F) << 12 | tail
    codes[lead >= 0xF0] = 0xFFFF
    return starts, codes


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte where each piece of each text starts, and for each text whether that is unsure."""
    at, codes = _characters(data)
    kind = _classes()[codes]
    row_first = np.searchsorted(at, offsets)  # first character of each text
    firsts = row_first[:-1][np.diff(offsets) > 0]
    count = len(at)
    new_text = np.zeros(count + 1, dtype=bool)
    new_text[firsts] = True
    new_text[count] = True
    edge = np.ones(count + 1, dtype=bool)  # a run of one class starts here
    edge[1:count] = kind[1:] != kind[:-1]
    edge |= new_text
    white = kind == WHITE
    start = edge[:count].copy()
    # A run that is not white takes one space before it along.
    start[1:] &= new_text[1:count] | white[1:] | (codes[:-1] != 0x20)
    # The last white character before other text is a piece of its own or goes with that text.
    last_white = white & edge[1:] & ~new_text[1:]
    start |= last_white
    # An apostrophe alone that starts a piece, and an ending after it.
    quote = np.flatnonzero((codes == 0x27) & start & edge[1:] & ~new_text[1:])
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.zeros(len(quote), dtype=np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                # Both letters are of the same text, as a text's first character starts a run.
                inside = ~edge[np.minimum(quote + 2, count)]
                fits &= (two == ord(ending[1])) & inside
            size = np.where((size == 0) & fits, len(ending), size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < count]] = True
    unsure = np.zeros(count + 1, dtype=np.int64)
    np.cumsum(kind == UNSURE, out=unsure[1:])
    return at[start], np.diff(unsure[row_first]) > 0


class Encoder:
    """Token ids of whole texts under one vocabulary file; remembers the pieces it has encoded."""

    def __init__(self, path: str):
        self.path = path
        self.by_piece = Tokenizer.from_file(path)
        self.by_piece.encode_special_tokens = True
        self.by_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        names = self.by_piece.get_vocab()
        #: Each character of a byte-level token stands for one byte.
        self.width = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, token in names.items():
            self.width[token] = len(name)
        self.forget()

    @cached_property
    def whole(self) -> Tokenizer:
        """For texts that cannot be split here; few tasks meet one."""
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def forget(self) -> None:
        """Free what the pieces so far take; workers outlive their tasks."""
        self.slots: dict[int, int] = {}
        self.tokens = np.empty(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)  # slot k holds tokens[begin[k]:begin[k + 1]]

    def _learn(self, hashes: list[int], pieces: list[str], sizes: np.ndarray) -> None:
        encoded = self.by_piece.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(encoded[0].ids, dtype=np.int32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
        known = len(self.slots)
        used = int(self.begin[known])
        if used + len(ids) > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * (used + len(ids)))
        if known + len(pieces) + 1 > len(self.begin):
            self.begin = np.resize(self.begin, 2 * (known + len(pieces) + 1))
        self.tokens[used : used + len(ids)] = ids
        self.begin[known + 1 : known + len(pieces) + 1] = used + ends
        self.slots.update(zip(hashes, range(known, known + len(pieces)), strict=True))

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and how many each text has."""
        starts, unsure = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = spans_hash(data, starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > REMEMBERED:
            self.forget()
        listed = distinct.tolist()
        new = [k for k, value in enumerate(listed) if value not in self.slots]
        if new:
            raw = data.tobytes()
            low, high = starts[where[new]], ends[where[new]]
            pieces = [raw[a:b].decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            self._learn([listed[k] for k in new], pieces, high - low)
        slot = np.fromiter(map(self.slots.__getitem__, listed), np.int64, len(listed))[back]
        counts = self.begin[slot + 1] - self.begin[slot]
        ids = self.tokens[ragged(self.begin[slot], counts)]
        upto = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=upto[1:])
        sizes = np.diff(upto[np.searchsorted(starts, offsets)])
        if unsure.any():
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(unsure).tolist():
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                parts[k] = np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, sizes

    def encode(self, column: pa.Array, end: int) -> pa.Array:
        """One list of ids for each text, each with the id `end` appended; null is an empty text."""
        parts, counts = [], [np.zeros(1, dtype=np.int64)]
        for _, data, offsets in text_parts(column, SPLIT_BYTES):
            ids, sizes = self._part(data, offsets)
            parts.append(np.insert(ids, np.cumsum(sizes), end))
            counts.append(sizes + 1)
        places = np.cumsum(np.concatenate(counts)).astype(np.int32)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(ids, pa.int32()))


@cache
def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return Encoder(path)
