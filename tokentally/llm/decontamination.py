"""Operator 7: benchmark items in documents, by CGK embedding, bit sampling and exact edit distance.

An item of n words is found in a document if some run of its words is within a word edit distance of
n / 5 of the item (whole numbers). Words are runs of letters, digits and non-ASCII characters with A-Z
lower-cased, so punctuation and layout make no difference.

1. Windows: an item within its bound shares a run of consecutive words with the document that the edits
   left whole (at least (n - d) / (d + 1) of them). Windows of the item's size are laid around every
   such run, at each start that d edits allow. Nothing that can match is lost here.
2. The CGK embedding walks over a window: each step writes the current word and moves on by a hash bit
   of word and step. Windows a few edits apart fall into step again, so edit distance becomes Hamming
   distance. WALKS walks, each with TABLES samples of SAMPLED steps, are looked up among the items' own:
   a window and an item are candidates if all steps of a sample agree.
3. Candidates are verified by the exact edit distance between the item and the best run around the window.
   An item within its bound has all but so many of its words there; candidates without them are told
   first, many at once, so items that only share an opening with a text cost little.

WALKS and TABLES are chosen so that items with as many random edits as the bound allows are found with
a probability above 0.99 (a test measures it). Items are the broadcast side: they are dealt into blocks
of about BLOCK_WORDS words and BLOCK_BYTES bytes at most, and documents are scanned for one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .texts import PUNCTUATION, Chunk, Powers, chunks, constants, mix, ragged, rolling_hash

#: One edit is allowed for so many words of an item.
WORDS_PER_EDIT = 5
#: Items with fewer words are not looked for: all are, those too short for an edit exactly as they are.
LEAST_WORDS = 1
WALKS = 8
TABLES = 12
SAMPLED = 2
#: Words of the items of a block, and bytes of its runs and keys, about.
BLOCK_WORDS = 4_000_000
BLOCK_BYTES = 64 << 20
#: Bits of the table that tells most runs of a document apart from those of items.
SIEVE_BITS = 22
#: Windows walked at once, and words of items and windows compared at once.
WINDOWS = 1 << 14
COMPARED = 1 << 21

_RUNS = Powers(81)
_U = np.uint64
#: What a walk writes beyond the end of a window.
_END = _U(0)


def allowed(words: int) -> int:
    return words // WORDS_PER_EDIT


def whole_run(words: int) -> int:
    """Consecutive words of an item that the allowed edits must leave whole somewhere."""
    return math.ceil((words - allowed(words)) / (allowed(words) + 1))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The words that a walk writes at each step, a row for each window words[start:end]."""
    place = starts.copy()
    out = np.empty((len(starts), steps), dtype=_U)
    salts = constants(1000 + walk, steps)
    last = max(0, len(words) - 1)
    for step in range(steps):
        inside = place < ends
        now = np.where(inside, words[np.minimum(place, last)], _END)
        out[:, step] = now
        place += inside & (mix(now ^ salts[step]) >> _U(63)).astype(bool)
    return out


def sampled_steps(walk: int, words: int) -> np.ndarray:
    """The steps of each table (rows) for windows of so many words: within the walk's likely span."""
    chance = np.random.default_rng(7000 + walk)
    return (chance.random((TABLES, SAMPLED)) * max(2, 3 * words // 2)).astype(int)


def window_keys(written_words: np.ndarray, walk: int, words: int) -> np.ndarray:
    """A key for each window and table."""
    steps = sampled_steps(walk, words)
    tables = constants(90 + walk, TABLES) + _U(words)
    key = np.repeat(tables[None, :], len(written_words), axis=0)
    for k in range(SAMPLED):
        key = mix(key + written_words[:, steps[:, k]])
    return key


def word_chunks(column: pa.Array) -> Iterator[Chunk]:
    return chunks(column, lower=True, between=PUNCTUATION)


class Items:
    """The items of a block, their runs, and the keys of their walks."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words = [], []
        for chunk in word_chunks(pa.array(texts, pa.string())):
            hashes = chunk.hashes()
            for k in range(chunk.rows):
                own = hashes[chunk.bounds[k] : chunk.bounds[k + 1]]
                if len(own) >= LEAST_WORDS:
                    self.ids.append(ids[chunk.first + k])
                    self.words.append(own)
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        #: By length of run: sorted hashes, and the item and place of each.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({whole_run(n) for n in self.sizes.tolist()}):
            own = [k for k, n in enumerate(self.sizes.tolist()) if whole_run(n) == length]
            found = [rolling_hash(self.words[k], length, _RUNS) for k in own]
            item = np.repeat(own, [len(f) for f in found])
            place = np.concatenate([np.arange(len(f)) for f in found])
            hashes = np.concatenate(found)
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
            sieve[hashes >> _U(64 - SIEVE_BITS)] = True
            self.runs[length] = hashes[order], item[order], place[order], sieve
        self.keys = [{} for _ in range(WALKS)]
        for size in sorted(set(self.sizes.tolist())):
            own = np.flatnonzero(self.sizes == size)
            flat = np.concatenate([self.words[k] for k in own])
            starts = np.arange(len(own)) * size
            for walk in range(WALKS):
                wrote = embed(flat, starts, starts + size, walk, _steps(size))
                keys = window_keys(wrote, walk, size)
                for table in range(TABLES):
                    order = np.argsort(keys[:, table], kind="stable")
                    self.keys[walk][size, table] = keys[order, table], own[order]


def _steps(size: int) -> int:
    return max(2, 3 * size // 2)


def _windows(items: Items, words: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
    """By size of item: the starts of windows around the runs that documents share with such items."""
    found: dict[int, list[np.ndarray]] = {}
    for length, (hashes, item, place, sieve) in items.runs.items():
        own = rolling_hash(words, length, _RUNS)
        at = np.flatnonzero(sieve[own >> _U(64 - SIEVE_BITS)])
        low = np.searchsorted(hashes, own[at], "left")
        count = np.searchsorted(hashes, own[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        hit = ragged(low, count)
        at = np.repeat(at, count)
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + length <= bounds[text + 1]
        at, hit, text = at[inside], hit[inside], text[inside]
        size = items.sizes[item[hit]]
        start = at - place[hit]
        for n in np.unique(size).tolist():
            mine = size == n
            edits = allowed(n)
            # Many items may lay a window at one start; each is walked once.
            of, base = _distinct(text[mine], start[mine])
            starts = (base[:, None] + np.arange(-edits, edits + 1)[None, :]).ravel()
            of = np.repeat(of, 2 * edits + 1)
            # A window may run over an end of the text by the edits allowed.
            fits = (starts + edits >= bounds[of]) & (starts + n - edits <= bounds[of + 1])
            found.setdefault(n, []).append(np.stack([of[fits], starts[fits]]))
    return {n: np.stack(_distinct(*np.concatenate(x, axis=1)), axis=1) for n, x in found.items()}


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of whole numbers (below 2**31 in size), in order."""
    keys = np.unique((first.astype(np.int64) << 32) + (second.astype(np.int64) + (1 << 31)))
    return keys >> 32, (keys & ((1 << 32) - 1)) - (1 << 31)


def _candidates(
    items: Items, words: np.ndarray, bounds: np.ndarray, size: int, windows: np.ndarray
) -> np.ndarray:
    """Distinct (window, item) that agree on a sample."""
    text, start = windows.T
    low, high = np.maximum(start, bounds[text]), np.minimum(start + size, bounds[text + 1])
    rows = []
    for walk in range(WALKS):
        keys = window_keys(embed(words, low, high, walk, _steps(size)), walk, size)
        for table in range(TABLES):
            known, own = items.keys[walk][size, table]
            first = np.searchsorted(known, keys[:, table], "left")
            count = np.searchsorted(known, keys[:, table], "right") - first
            hit = np.flatnonzero(count)
            if len(hit):
                rows.append(np.stack([np.repeat(hit, count[hit]), own[ragged(first[hit], count[hit])]]))
    if not rows:
        return np.empty((0, 2), dtype=np.int64)
    return np.stack(_distinct(*np.concatenate(rows, axis=1)), axis=1)


def _regions(
    items: Items, words: np.ndarray, bounds: np.ndarray, size: int, windows: np.ndarray, found: np.ndarray
) -> np.ndarray:
    """text, item, low, high of the stretches of words around candidates that may hold an item.

    Windows of one text and item that overlap are one stretch. A stretch with too few of the item's words
    goes: an item within its bound has at least `size` less the edits of them.
    """
    edits = allowed(size)
    text, start = windows[found[:, 0]].T
    item = found[:, 1]
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    text, item = text[at], item[at]
    low = np.maximum(start[at] - edits, bounds[text])
    high = np.minimum(start[last] + size + 2 * edits, bounds[text + 1])
    few = np.empty(len(text), dtype=bool)
    width = high - low
    by_width = np.argsort(width, kind="stable")
    first = 0
    while first < len(by_width):
        # As many stretches as fit, each filled up to the longest of them with its own last word.
        step = max(1, COMPARED // (size * int(width[by_width[min(first + 255, len(by_width) - 1)]])))
        some = by_width[first : first + min(step, 256)]
        wide = int(width[some].max())
        place = np.minimum(low[some][:, None] + np.arange(wide), high[some][:, None] - 1)
        wanted = np.stack([items.words[k] for k in item[some].tolist()])
        there = (wanted[:, :, None] == words[place][:, None, :]).any(axis=2)
        few[some] = there.sum(axis=1) < size - edits
        first += len(some)
    return np.stack([text, item, low, high], axis=1)[~few]


def edit_distances(item: np.ndarray, words: np.ndarray, anywhere: bool) -> np.ndarray:
    """For each end in words, the edit distance between the item and the words before it.

    With `anywhere`, the smallest one over all runs that end there.
    """
    places = np.arange(len(words) + 1)
    row = np.zeros_like(places) if anywhere else places
    for k, word in enumerate(item.tolist(), 1):
        now = np.empty_like(row)
        now[0] = k
        now[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(now - places) + places
    return row


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the run of words nearest to the item: the earliest end, then the longest."""
    row = edit_distances(item, words, anywhere=True)
    end = int(np.argmin(row))
    back = edit_distances(item[::-1], words[:end][::-1], anywhere=False)
    return int(row[end]), end - int(np.flatnonzero(back == row[end]).max()), end


def find_items(items: Items, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end) of the best run for each item found in each text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for size, windows in _windows(items, words, bounds).items():
        edits = allowed(size)
        for k in range(0, len(windows), WINDOWS):
            found = _candidates(items, words, bounds, size, windows[k : k + WINDOWS])
            if not len(found):
                continue
            for text, item, low, high in _regions(items, words, bounds, size, windows[k : k + WINDOWS], found).tolist():
                distance, first, end = best_run(items.words[item], words[low:high])
                first_word = low - int(bounds[text])
                mine = (distance, first + first_word, end + first_word)
                if distance <= edits and mine < best.get((text, item), (edits + 1, 0, 0)):
                    best[text, item] = mine
    return [(*key, *value) for key, value in best.items()]


_MATCH = "doc_id long, tie long, item_id long, n_words long, edits long, first long, last long"


def _scan(documents: DataFrame, items: Items) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)  # about BLOCK_WORDS words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for chunk in word_chunks(batch.column(2)):
                rows = []
                for text, item, edits, first, end in find_items(items, chunk.hashes(), chunk.bounds):
                    row = chunk.first + text
                    doc, tie = (batch.column(c)[row].as_py() for c in (0, 1))
                    rows.append((doc, tie, items.ids[item], len(items.words[item]), edits, first, end - 1))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)],
                        ["doc_id", "tie", "item_id", "n_words", "edits", "first", "last"],
                    )

    return documents.mapInArrow(scan, _MATCH)


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tie, item_id, n_words, edits, first, last: the best run of words for each document and item.

    n_words: words of the item; first and last: places (from 0) of the document's words. Null or empty
    texts match nothing, and items without words are not looked for. Rows that repeat in either table give repeated rows. tie is a hash of the document's text.
    """
    items = written(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null"), "items"
    )
    count = F.coalesce(F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long")), F.lit(0))
    words, rows = items.agg(count, F.count(F.lit(1))).first()
    # A run and its place are 24 bytes a word, the word itself 8; a key and its item 16 bytes in each table.
    held = 32 * words + 16 * WALKS * TABLES * rows
    blocks = max(1, math.ceil(words / BLOCK_WORDS), math.ceil(held / BLOCK_BYTES))
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text"
    )
    found = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()
        held = Items(own["item_id"].to_pylist(), own["text"].to_pylist())
        if held.ids:
            found.append(_scan(texts, held))
    if not found:
        return documents.sparkSession.createDataFrame([], _MATCH)
    return reduce(DataFrame.unionByName, found)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    Rows are told apart by doc_id and text, so a null doc_id is judged by its text like any other.
    """
    bad = matches(documents, benchmark).select(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie")).distinct()
    rows = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("document"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("tie"),
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie"))
    return rows.join(written(bad, "matches"), same, "left_anti").select("document.*")
