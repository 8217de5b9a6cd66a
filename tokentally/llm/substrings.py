"""Operator 10: remove word sequences that repeat anywhere in the corpus, found by recompression.

A window is `width` consecutive words of one document; a word is removed if a window over it has a word
sequence that also starts elsewhere, in the same document too.

1. Every text is recompressed (`recompression`), and the names of its symbols whose context fits into a
   window are counted over the corpus. A window around a symbol that occurs once cannot repeat.
2. The windows left, little more than those that do repeat, are counted by a 128-bit hash of their
   words. That verifies the repeats: the result does not depend on names.
3. Texts of documents with repeats are cut; the others were finished in step 2.

Names and windows are counted in packs: distinct values of about a megabyte of texts travel as sorted
binary runs to ranges of values, and flags travel back. A value that very many documents hold is sent
once for each pack, and no row stands for a single word. There is a range for each 16 MB of text, so the
share of a task does not grow with the corpus. Beyond 4,096 ranges, packs are dealt to coarse ones and
the runs of a coarse range to fine ones, so packs do not grow either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .groups import whole_groups
from .recompression import Symbols, recompress
from .texts import Chunk, Powers, chunks

WIDTH = 35
#: Bytes of values that make a pack, and bytes for each part that values are dealt to, at least.
PACK_BYTES = 256 << 10
PART_BYTES = 512
#: Bytes of text for each range of values, about. The values of a range are counted at once.
RANGE_BYTES = 16 << 20
#: Ranges that the values of documents are dealt to at most; more are reached by a second dealing.
MOST_PARTS = 4096

_ONE, _TWO = Powers(61), Powers(62)
_KEYS = ["k1", "k2"]
_PACKED = "kind int, part int, uid long, content binary, k1 array<long>, k2 array<long>, sizes array<int>"
_PACKED_TYPES = [
    pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())
]
_PACKED_NAMES = ["kind", "part", "uid", "content", "k1", "k2", "sizes"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _PACKED_NAMES]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, _PACKED_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _PACKED_NAMES)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows of values, for each row its place among them, and how often each occurs."""
    order = np.lexsort(values.T[::-1]) if values.shape[1] > 1 else np.argsort(values[:, 0], kind="stable")
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(values), dtype=np.uint32)
    place[order] = (np.cumsum(new) - 1).astype(np.uint32)
    first = np.flatnonzero(new)
    return ordered[first], place, np.diff(np.append(first, len(values)))


def _pack(width: int, parts: int, enough: int):
    """Packs of rows k1, k2, values: a run of sorted distinct values for each range, and a layout."""

    def one(uid: int, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(-1, width)
        distinct, place, _ = _distinct(values)
        part = ((distinct[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(first[1:], len(part))
        out = [
            (0, p, uid, distinct[a:b].tobytes(), None, None, None)
            for p, a, b in zip(part[first].tolist(), first.tolist(), ends.tolist())
        ]
        sizes = [len(h[2]) // (8 * width) for h in held]
        out.append((1, uid % parts, uid, place.tobytes(), [h[0] for h in held], [h[1] for h in held], sizes))
        return _packed(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(key)
                size += len(key[2])
                if size >= enough:
                    yield one(uid, held)
                    uid, held, size = uid + 1, [], 0
        if held:
            yield one(uid, held)

    return scan


def _count(width: int):
    """Runs of a range become flags: whether the value is in another run, too. Layouts pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["part"]):
            kinds = table.column("kind").to_numpy()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                layouts = table.slice(low, high - low).filter(pa.array(kinds[low:high] == 1))
                yield from layouts.to_batches()
                runs = table.slice(low, high - low).filter(pa.array(kinds[low:high] == 0))
                if not runs.num_rows:
                    continue
                content = runs.column("content").to_pylist()
                values = np.frombuffer(b"".join(content), np.uint64).reshape(-1, width)
                _, place, times = _distinct(values)
                flags = np.split(times[place] > 1, np.cumsum([len(c) // (8 * width) for c in content])[:-1])
                uids, part = runs.column("uid").to_pylist(), runs.column("part")[0].as_py()
                yield _packed(
                    [(0, part, u, f.tobytes(), None, None, None) for u, f in zip(uids, flags, strict=True)]
                )

    return scan


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flags of packs, each after its layout, as rows k1, k2, flags."""
    for table, bounds in whole_groups(batches, ["uid"]):
        content = table.column("content").to_pylist()
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            place = np.frombuffer(content[low], np.uint32)  # the layout is first
            flags = np.frombuffer(b"".join(content[low + 1 : high]), bool)
            flags = (flags | (np.bincount(place, minlength=len(flags)) > 1))[place] if len(place) else flags
            k1, k2, sizes = (table.column(c)[low].values for c in ("k1", "k2", "sizes"))
            ends = np.cumsum(sizes.to_numpy())
            own = [x.tobytes() for x in np.split(flags, ends[:-1])]
            yield pa.RecordBatch.from_arrays([k1, k2, pa.array(own, pa.binary())], ["k1", "k2", "flags"])


def _counted(packs: DataFrame, width: int, parts: int) -> DataFrame:
    by_part = packs.repartition(parts, "part") if parts > _partitions(packs) else packs.repartition("part")
    return by_part.sortWithinPartitions("part").mapInArrow(_count(width), _PACKED)


def _unpacked(counted: DataFrame) -> DataFrame:
    by_pack = counted.repartition("uid").sortWithinPartitions("uid", F.desc("kind"), "part")
    return by_pack.mapInArrow(_unpack, "k1 long, k2 long, flags binary")


def repeated(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """k1, k2, flags: for each row's values (binary, `width` numbers of 64 bits each), whether a value
    occurs elsewhere too. Rows with one key hold the same values, and one of them is returned.

    With more ranges than MOST_PARTS, the runs that packs send to a coarse range are themselves rows to pack,
    by coarse range, for the fine ones; their flags go back to the packs that sent them.
    """
    coarse = min(parts, MOST_PARTS)
    packs = rows.select("k1", "k2", "values").mapInArrow(
        _pack(width, coarse, max(PACK_BYTES, PART_BYTES * coarse)), _PACKED
    )
    if parts == coarse:
        return _unpacked(_counted(packs, width, parts)).groupBy(*_KEYS).agg(F.first("flags").alias("flags"))
    packs = written(packs, "packs")  # read for runs and for layouts
    share = -(-parts // coarse)
    runs = packs.where("kind = 0").select(
        F.col("uid").alias("k1"), F.col("part").cast("long").alias("k2"), F.col("content").alias("values")
    )
    runs = runs.repartition("k2", F.pmod(F.xxhash64("k1"), F.lit(share))).sortWithinPartitions("k2", "k1")
    again = runs.mapInArrow(_pack(width, parts, max(PACK_BYTES, PART_BYTES * share)), _PACKED)
    flags = _unpacked(_counted(again, width, parts)).select(
        F.lit(0).alias("kind"), F.col("k2").cast("int").alias("part"), F.col("k1").alias("uid"),
        F.col("flags").alias("content"), *(F.lit(None).cast(packs.schema[c].dataType).alias(c) for c in _PACKED_NAMES[4:]),
    )
    counted = packs.where("kind = 1").unionByName(flags)
    return _unpacked(counted).groupBy(*_KEYS).agg(F.first("flags").alias("flags"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _parts(texts: DataFrame) -> int:
    """Ranges of values: one for each RANGE_BYTES of text, as many as there are shuffle partitions at least."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(_partitions(texts), -(-size // RANGE_BYTES))


def _usable(chunk: Chunk, hashes: np.ndarray, width: int) -> tuple[Symbols, np.ndarray]:
    """The symbols whose context lies in a window of their own text, and how many each text has."""
    symbols = recompress(hashes, chunk.bounds)
    text = np.searchsorted(chunk.bounds, symbols.start, "right") - 1
    inside = (symbols.low >= chunk.bounds[text]) & (symbols.high <= chunk.bounds[text + 1])
    inside &= symbols.high - symbols.low <= width
    return symbols.take(inside), np.bincount(text[inside], minlength=chunk.rows)


def _names(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                symbols, sizes = _usable(chunk, chunk.hashes(), width)
                names = [x.tobytes() for x in np.split(symbols.name, np.cumsum(sizes)[:-1])]
                rows = slice(chunk.first, chunk.first + chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(names, pa.binary())],
                    ["k1", "k2", "values"],
                )

    return scan


def kept_texts(chunk: Chunk, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    change = np.zeros(len(chunk.data) + 1, dtype=np.int8)
    starts, ends = chunk.starts[keep], chunk.ends[keep]
    change[starts] = 1
    change[ends] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    owner = chunk.row_of_word()[keep]
    more = np.zeros(len(owner), dtype=bool)
    more[:-1] = owner[1:] == owner[:-1]  # another kept word of the text follows, so a byte does
    gaps = ends[more]
    mask[gaps] = True
    data = chunk.data.copy()
    data[gaps] = 0x20
    sizes = np.add.reduceat(np.append(mask, False), chunk.offsets[:-1]) if chunk.rows else np.empty(0, int)
    sizes = np.where(np.diff(chunk.offsets) > 0, sizes, 0)
    content = data[mask].tobytes()
    ends = np.cumsum(sizes).tolist()
    return [content[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_FOUND = "doc_id long, k1 long, k2 long, n_words long, kept_sha256 string, starts binary, text string"


def _windows(width: int):
    """Texts without a possible repeat are finished; the others give the starts of windows to count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(4)
            for chunk in chunks(batch.column(3)):
                yield part(batch.slice(chunk.first, chunk.rows), flags.slice(chunk.first, chunk.rows), chunk)

    def part(batch: pa.RecordBatch, flags: pa.Array, chunk: Chunk) -> pa.RecordBatch:
        hashes = chunk.hashes()
        count = len(hashes)
        symbols, _ = _usable(chunk, hashes, width)
        alone = ~np.frombuffer(b"".join(flags.to_pylist()), bool)
        change = np.zeros(count + 2, dtype=np.int64)
        np.add.at(change, np.maximum(symbols.high[alone] - width, 0), 1)
        np.add.at(change, symbols.low[alone] + 1, -1)
        n_words = np.diff(chunk.bounds)
        left = np.repeat(chunk.bounds[1:], n_words) - np.arange(count)  # words to the text's end
        starts = np.flatnonzero((np.cumsum(change)[:count] == 0) & (left >= width))
        cuts = np.searchsorted(starts, chunk.bounds)
        some = np.diff(cuts) > 0
        whole = kept_texts(chunk, np.ones(count, dtype=bool))
        pending = some.tolist()
        own = [
            (starts[a:b] - first).astype(np.int32).tobytes() if b > a else None
            for a, b, first in zip(cuts[:-1], cuts[1:], chunk.bounds[:-1], strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()),
                pa.array([None if p else hashlib.sha256(w).hexdigest() for p, w in zip(pending, whole)], pa.string()),
                pa.array(own, pa.binary()),
                pa.array([w.decode() if p else None for p, w in zip(pending, whole)], pa.string()),
            ],
            ["doc_id", "k1", "k2", "n_words", "kept_sha256", "starts", "text"],
        )

    return scan


def _hashes(width: int):
    """128 bits of the words of each window that starts at one of `starts`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(2)
            for chunk in chunks(batch.column(3)):
                own = [np.frombuffer(starts[chunk.first + k].as_py(), np.int32) for k in range(chunk.rows)]
                sizes = np.array([len(x) for x in own])
                at = np.concatenate(own) + np.repeat(chunk.bounds[:-1], sizes)
                hashes = chunk.hashes()
                values = np.empty((len(at), 2), dtype=np.uint64)
                for k, powers in enumerate((_ONE, _TWO)):
                    up, down = powers.to(len(hashes) + 1)
                    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
                    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
                    values[:, k] = (sums[at + width] - sums[at]) * down[at]
                rows = slice(chunk.first, chunk.first + chunk.rows)
                content = [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(content, pa.binary())],
                    ["k1", "k2", "values"],
                )

    return scan


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"


def _cut(width: int):
    """Cover the repeated windows and keep the rest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n_words, starts, flags = (batch.column(k) for k in range(4))
            for chunk in chunks(batch.column(4)):
                change = np.zeros(len(chunk.starts) + 1, dtype=np.int64)
                for k in range(chunk.rows):
                    row = chunk.first + k
                    flag = np.frombuffer(flags[row].as_py(), bool)
                    at = np.frombuffer(starts[row].as_py(), np.int32)[flag] + chunk.bounds[k]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + width, -1)
                gone = np.cumsum(change)[:-1] > 0
                rows = slice(chunk.first, chunk.first + chunk.rows)
                removed = np.add.reduceat(np.append(gone, False), chunk.bounds[:-1])
                spans = [
                    _spans(gone[a:b]) for a, b in zip(chunk.bounds[:-1], chunk.bounds[1:], strict=True)
                ]
                kept = [hashlib.sha256(w).hexdigest() for w in kept_texts(chunk, ~gone)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc[rows], n_words[rows], pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
                )

    return scan


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    pairs = zip(np.flatnonzero(edges > 0).tolist(), (np.flatnonzero(edges < 0) - 1).tolist(), strict=True)
    return [{"first": a, "last": b} for a, b in pairs]


def without_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of every document.

    spans: first and last place (from 0) of each run of removed words. kept_sha256 is of the kept words
    joined by one space. A null or empty text has no words. Repeated rows are places of their own, so
    they remove each other's windows. A text shorter than a window keeps all its words.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.xxhash64("text", F.lit(1), "doc_id").alias("k2"),
        "text",
    )
    parts = _parts(documents)
    names = texts.select("k1", "k2", "text").mapInArrow(_names(width), "k1 long, k2 long, values binary")
    found = written(
        texts.join(repeated(names, 1, parts), _KEYS)
        .select("doc_id", "k1", "k2", "text", "flags")
        .mapInArrow(_windows(width), _FOUND),
        "windows",
    )
    pending = found.where("text is not null")
    windows = pending.select("k1", "k2", "starts", "text").mapInArrow(
        _hashes(width), "k1 long, k2 long, values binary"
    )
    cut = (
        pending.select("doc_id", "k1", "k2", "n_words", "starts", "text")
        .join(repeated(windows, 2, parts), _KEYS)
        .select("doc_id", "n_words", "starts", "flags", "text")
        .mapInArrow(_cut(width), _RESULT)
    )
    spans = F.array().cast("array<struct<first:int,last:int>>")
    done = found.where("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", spans.alias("spans")
    )
    return done.unionByName(cut)
