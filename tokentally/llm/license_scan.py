"""Operator 2: license notices by conditional compression.

Candidate blocks are runs of words around a cue ("licens", "copyright" ...), over line ends and blank
lines: for each template that holds the cue, the words where the template would lie, and as many more on
both sides as it may differ in. Runs that lack too many words of the template cannot hold it and are left
out. Each block is compressed by zstandard alone and with every template as a raw dictionary; the
templates that save enough are confirmed by exact wording: the words of the template that the block lacks
or has otherwise, by an edit distance to the best run of the block. The confirmed template with most words
right wins the block, then the one that saves more bytes; of notices that share words, the one with most
words right stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .decontamination import best_run, edit_distances
from .groups import whole_groups
from .license_texts import CUES, TEMPLATES

LEVEL = 3
#: Share of a block's compressed bytes that a template must save to be looked at. With as many differences
#: as are allowed, and words around it that do not compress, every template saves more than 0.2 (a test).
LEAST_SAVED = 0.1
#: A template is confirmed with at most one different word for so many of its words.
WORDS_PER_DIFFERENCE = 8
_CUES = "|".join(r"\s+".join(cue.split()) for cue in CUES)  # a cue may be wrapped
_CUE = re.compile(_CUES, re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case, without punctuation around them."""
    return [word.lower() for word in _WORD.findall(text)]


def numbers(text: Sequence[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.setdefault(w, len(known)) for w in text], dtype=np.int64)


class Templates:
    """License texts, prepared for compression and comparison."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.licenses = [name for name, _ in templates]
        self.words = [words(text) for _, text in templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.with_template = []
        for _, text in templates:
            own = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)
            )

    def saved(self, block: str) -> np.ndarray:
        """Bytes that each template saves, and what the block takes alone (last)."""
        data = " ".join(block.lower().split()).encode()
        alone = len(self.alone.compress(data))
        return np.array([*(alone - len(c.compress(data)) for c in self.with_template), alone])

    def judge(self, block: str) -> tuple | None:
        """(license, template, saved share, differences, first word, last word) of the winner, or None."""
        *saved, alone = self.saved(block).tolist()
        known: dict[str, int] = {}
        own = numbers(words(block), known)
        best = None
        for k in [k for k in range(len(saved)) if saved[k] >= LEAST_SAVED * alone]:
            wanted = numbers(self.words[k], known)
            if not len(own) or not len(wanted):
                continue
            differences = int(edit_distances(wanted, own, anywhere=True).min())
            if differences <= len(wanted) // WORDS_PER_DIFFERENCE:
                rank = (2 * differences - len(wanted), -saved[k], k)
                if best is None or rank < best[0]:
                    _, first, end = best_run(wanted, own)
                    best = rank, (self.licenses[k], k, saved[k] / alone, differences, first, end - 1)
        return best and best[1]


def _cues(text: str, starts: list[int]) -> list[tuple[str, int]]:
    """Each cue of a text and the number of the word it begins in."""
    found = ((" ".join(m.group().lower().split()), m.start()) for m in _CUE.finditer(text))
    return [(cue, bisect_right(starts, place) - 1) for cue, place in found]


@lru_cache(maxsize=4)
def _runs(known: tuple) -> dict[str, list[tuple[int, int, frozenset, int]]]:
    """For each cue: words before it and from it on that a template takes, its distinct words, and how many may lack."""
    runs: dict[str, set] = {}
    for _, text in known:
        starts = [m.start() for m in _WORD.finditer(text)]
        edits = len(starts) // WORDS_PER_DIFFERENCE
        for cue, at in _cues(text, starts):
            run = at + edits, len(starts) - at + edits, frozenset(words(text)), edits
            runs.setdefault(cue, set()).add(run)
    return {cue: sorted(own, key=lambda run: (*run[:2], sorted(run[2]))) for cue, own in runs.items()}


def windows(text: str, known: tuple) -> list[tuple[int, int, str]]:
    """(first word, its line, text) of each run of words that may hold a template."""
    places = [m.span() for m in _WORD.finditer(text)]
    own = [text[a:b].lower() for a, b in places]
    runs, found = _runs(known), set()
    for cue, at in _cues(text, [a for a, _ in places]):
        for before, after, wanted, edits in runs.get(cue, ()):
            low, high = max(0, at - before), min(len(own), at + after)
            if (low, high) not in found and len(wanted.intersection(own[low:high])) >= len(wanted) - edits:
                found.add((low, high))
    lines = [m.start() for m in re.finditer("\n", text)]
    return [(x, bisect_right(lines, places[x][0]), text[places[x][0] : places[y - 1][1]]) for x, y in sorted(found)]


def blocks(text: str, templates: Sequence[tuple[str, str]] = TEMPLATES) -> Iterator[tuple[int, list[str]]]:
    """(first line, lines) of each candidate block."""
    for _, line, block in windows(text, tuple(templates)):
        yield line, block.split("\n")


def _lines_of(block: list[str], first: int, last: int) -> tuple[int, int]:
    """The first and last line that hold the words first..last of a block."""
    ends = np.cumsum([len(words(line)) for line in block])
    return int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "right"))


def judgement(templates: Templates, block: str) -> tuple | None:
    """(license, template, saved, differences, first line, last line, words right) of a block, or None."""
    winner = templates.judge(block)
    if not winner:
        return None
    license_, template, saved, differences, first, last = winner
    low, high = _lines_of(block.split("\n"), first, last)
    return license_, template, saved, differences, low, high, len(templates.words[template]) - 2 * differences


def without_overlaps(found: list[tuple[int, int, int, int]]) -> list[int]:
    """Of notices (words right, first and last word or line, number) those that stay, by number.

    Of notices that share words (lines) the one with most words right stays, then the first one.
    """
    taken: set[int] = set()
    kept = []
    for _, low, high, number in sorted(found, key=lambda x: (-x[0], *x[1:])):
        places = range(low, high + 1)
        if taken.isdisjoint(places):
            taken.update(places)
            kept.append(number)
    return kept


@lru_cache(maxsize=4)
def _templates(known: tuple) -> Templates:
    return Templates(known)


def _candidates(known: tuple):
    """The candidate blocks of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (row, doc, *block)
                for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for block in windows(text, known)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                ["row", "doc_id", "word", "start", "block"],
            )

    return scan


def _winners(known: tuple):
    types = [pa.string(), pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 3]
    names = ["block", "license", "template", "saved", "differences", "first", "last"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _templates(known)
        for batch in batches:
            found = [(block, own.judge(block)) for block in batch.column(0).to_pylist()]
            rows = [(block, *result) for block, result in found if result]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names
            )

    return scan


_NOTICE = "doc_id long, line int, license string, template int, saved double, differences int, notice string"


def _resolved(known: tuple):
    """The notices of each text that stay, with their lines."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(own) for own in _templates(known).words]
        for table, bounds in whole_groups(batches, ["row"]):
            names = ("word", "first", "last", "template", "differences")
            at, firsts, lasts, own, wrong = (table.column(c).to_pylist() for c in names)
            kept = []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                kept += without_overlaps(
                    [(sizes[own[k]] - 2 * wrong[k], at[k] + firsts[k], at[k] + lasts[k], k) for k in range(x, y)]
                )
            chosen = table.take(pa.array(kept, pa.int64()))
            lines, texts = [], []
            for start, block, k in zip(*(chosen.column(c).to_pylist() for c in ("start", "block")), kept, strict=True):
                places = [m.span() for m in _WORD.finditer(block)]
                low, high = places[firsts[k]][0], places[lasts[k]][1]
                lines.append(start + block.count("\n", 0, low))
                texts.append(block[low:high])
            own_columns = [chosen.column(c) for c in ("doc_id", "license", "template", "saved", "differences")]
            doc, *rest = (c.combine_chunks() for c in own_columns)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(lines, pa.int32()), *rest, pa.array(texts, pa.string())],
                ["doc_id", "line", "license", "template", "saved", "differences", "notice"],
            )

    return scan


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, line, license, template, saved, differences, notice of every notice found.

    line: number of the notice's first line (from 0); saved: share of its block's compressed bytes that the
    template saves; differences: words that differ from the template; notice: from the first to the last
    word. Null and empty texts have none.
    Repeated rows give repeated notices.

    The same few notices stand in very many documents, so every distinct block is compressed and
    compared once, wherever it stands, and the result is joined back to its places.
    """
    known = tuple(templates)
    # Texts without any cue stay in the JVM.
    cued = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).where(F.col("text").rlike("(?i)" + _CUES))
    schema = "row long, doc_id long, word int, start int, block string"
    places = written(cued.mapInArrow(_candidates(known), schema), "blocks")
    judged = places.select("block").distinct().mapInArrow(
        _winners(known),
        "block string, license string, template int, saved double, differences int, first int, last int",
    )
    return (
        places.join(judged, "block")
        .repartition("row")
        .sortWithinPartitions("row", "word", "block")
        .mapInArrow(_resolved(known), _NOTICE)
    )
