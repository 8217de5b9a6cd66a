"""Operator 9: cross-entropy difference of documents under a target and a background model.

Both are bigram models over one vocabulary, interpolated with their unigrams by the same weights. The
target model counts the documents marked as target, the background model all others; all words of all
documents count, and documents are scored by the models that hold them. A document's score is the mean
over its words of the loss under the target model less that under the background model (in bits): low
scores are like the target.

1. Words are counted. All of them are known to the models; the most frequent ones are the hot words.
2. Documents become stored packs of some documents each: the hashes of a pack's other words, and all
   its words as numbers within the pack.
3. Words and pairs of the hot words are counted in dense tables of fixed size, so a pair that every
   document holds never gathers in one task.
4. The other words and pairs: the distinct ones of a pack go by hash, as sorted runs with their counts,
   to ranges of it, where they are added up over the corpus; the sums go back to the packs. What travels
   is in proportion to the input, and no row stands for a single word.
5. Each pack adds up the losses of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import short_lived_tables, written
from .groups import BATCH_BYTES, TABLE_CODEC, settings, whole_groups
from .texts import chunks, mix

START = 0
#: Word numbers below are hot: the start, and the most frequent words.
HOT = 256
#: Weight of the bigram estimate if the word before was seen.
BIGRAM = 0.7
#: Added to each word's count.
ADDED = 0.1
#: Words that make a pack of documents, and words for each part that pairs are dealt to, at least.
PACK_WORDS = 1 << 18
PACK_PAIRS = 128
#: Parts that packs are dealt to at most; more are reached by a second dealing.
MOST_PARTS = 4096
#: Up to so many target ids are broadcast (some 50 MB); beyond, they are joined, and texts shuffled for it.
BROADCAST_TARGETS = 2_000_000
#: Words for each part of the hash ranges, about: what a task adds up at once.
PART_WORDS = 1 << 20
#: Bytes of packs or counts that a task gathers before it handles them, and of the batches it gets them in.
SLAB = 4 << 20
BATCH = 2 << 20


def vocabulary(documents: DataFrame) -> tuple[np.ndarray, int, int]:
    """Hashes of the hot words, most frequent first, ties by hash; the number of distinct words, and of all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), limit=1 << 20):
                words, times = np.unique(chunk.hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "n"]
                )

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's most frequent words, and a row without a word: numbers of distinct words and of all."""
        held, distinct, total = [np.empty(0, np.int64), np.empty(0, np.int64)], 0, 0
        for batch in batches:
            words, n = (c.to_numpy() for c in batch.columns)
            distinct, total = distinct + len(words), total + int(n.sum())
            words, n = np.concatenate([held[0], words]), np.concatenate([held[1], n])
            order = np.lexsort((words, -n))[: HOT - 1]
            held = [words[order], n[order]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*held, held[0] * 0)], ["word", "n", "total"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([distinct]), pa.array([total])], ["word", "n", "total"]
        )

    found = documents.select("text").mapInArrow(scan, "word long, n long")
    counts = found.groupBy("word").agg(F.sum("n").alias("n"))
    tops = written(counts.mapInArrow(top, "word long, n long, total long"), "top_words")
    words = tops.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(HOT - 1).select("word").toArrow()
    sums = tops.where("word IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "total"))).first()
    return words["word"].to_numpy().view(np.uint64), *sums


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, tie, target, text with `text` replaced by `words`: a 64-bit hash of each."""
    for batch in batches:
        for chunk in chunks(batch.column(3)):
            hashes = chunk.hashes()
            own = [hashes[a:b].tobytes() for a, b in zip(chunk.bounds[:-1], chunk.bounds[1:], strict=True)]
            rows = [c.slice(chunk.first, chunk.rows) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(own, pa.binary())], ["doc_id", "tie", "target", "words"])


def _pairs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (START first), as numbers, and the document of each word."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[firsts] = START
    return before.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as bytes that compress well: the steps between them, first bytes first."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueezed(content: bytes) -> np.ndarray:
    steps = np.frombuffer(content, np.uint8).reshape(8, -1).T.copy()
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def squeezed_counts(counts: np.ndarray) -> bytes:
    """A table of numbers as bytes that compress well: in as few bytes each as they need, column by column
    and first bytes first, after the number of bytes."""
    largest = int(counts.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if largest < 1 << 8 * k)
    planes = np.ascontiguousarray(counts, dtype=f"<u{size}").view(np.uint8)
    return bytes([size]) + planes.reshape(len(counts), counts.shape[1] * size).T.tobytes()


def unsqueezed_counts(content: bytes, width: int) -> np.ndarray:
    size = content[0]
    planes = np.frombuffer(content, np.uint8, offset=1).reshape(width * size, -1)
    return planes.T.copy().view(f"<u{size}").astype(np.int64)


_PACKS = (
    "uid long, doc_id array<long>, tie array<long>, sizes array<int>, target array<boolean>, "
    "known binary, words binary"
)
_PACK_NAMES = ["uid", "doc_id", "tie", "sizes", "target", "known", "words"]


def packed(rows: DataFrame, words: int, hot: np.ndarray) -> DataFrame:
    """Rows of doc_id, tie, text and target put together to packs of so many words at least.

    known: sorted hashes of the words that are not hot; words: numbers from HOT on stand for these.
    """
    order = np.argsort(hot)
    hot, numbers = hot[order], (order + 1).astype(np.uint32)  # HOT - 1 words at most

    def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros(len(hashes), dtype=np.uint32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
            ids = np.where(hot[at] == hashes, numbers[at], ids)
        rare = ids == START
        known, place = np.unique(hashes[rare], return_inverse=True)
        ids[rare] = HOT + place
        return known, ids

    def one(uid: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        content = table.column("words").to_pylist()
        sizes = pa.array([len(c) // 8 for c in content], pa.int32())
        known, ids = numbered(np.frombuffer(b"".join(content), np.uint64))
        lists = [table.column("doc_id"), table.column("tie"), sizes, table.column("target")]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays(
            [pa.array([uid], pa.int64()), *whole, pa.array([squeezed(known)]), pa.array([squeezed_counts(ids[:, None])])], _PACK_NAMES
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in _hashed(batches):
            ends = np.cumsum([len(c) // 8 for c in batch.column("words").to_pylist()])
            first = 0
            while first < batch.num_rows:
                done = int(ends[first - 1]) if first else 0
                last = int(np.searchsorted(ends, done + words - size, "left")) + 1
                last = min(last, batch.num_rows)
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - done
                first = last
                if size >= words:
                    yield one(uid, held)
                    uid, held, size = uid + 1, [], 0
        if held:
            yield one(uid, held)

    return rows.select("doc_id", "tie", "target", "text").mapInArrow(scan, _PACKS)


@dataclass
class Pack:
    """The words of some documents, each with the one before it and its document; hashes of words not hot."""

    words: np.ndarray
    before: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    known: np.ndarray

    @property
    def hot(self) -> np.ndarray:
        return (self.before < HOT) & (self.words < HOT)

    def rare_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted 64-bit hashes of the distinct pairs that are not hot; the place of each such word among them."""
        rare = ~self.hot
        names = np.concatenate([mix(np.arange(1, HOT + 1)), self.known])
        return np.unique(mix(mix(names[self.before[rare]]) + names[self.words[rare]]), return_inverse=True)


def _cuts(hashes: np.ndarray, parts: int, first: int = 0, last: int | None = None) -> list[int]:
    """Where each range of sorted hashes begins, from the range `first` to `last`, and the end."""
    bounds = np.arange(first, parts + 1 if last is None else last + 2).astype(np.uint64)
    return np.searchsorted(_ranges(hashes, parts), bounds).tolist()


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _pack(words: bytes, sizes: np.ndarray, target: np.ndarray, known: bytes) -> Pack:
    ids = unsqueezed_counts(words, 1).ravel()
    before, owner = _pairs_of(ids, sizes)
    return Pack(ids, before, owner, target, unsqueezed(known))


def _packs(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Pack]]:
    columns = (table.column(c) for c in ("uid", "sizes", "target", "known", "words"))
    for uid, sizes, target, known, words in zip(*columns, strict=True):
        own = sizes.values.to_numpy(), target.values.to_numpy(zero_copy_only=False)
        yield uid.as_py(), _pack(words.as_py(), *own, known.as_py())


@dataclass(frozen=True)
class Model:
    """Counts of hot words, of hot words as the one before, of hot pairs, and of all words; a column each for
    target and rest. size: number of distinct words."""

    words: np.ndarray
    before: np.ndarray
    hot: np.ndarray
    total: np.ndarray
    size: int

    def loss(self, words: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Bits of words under both models that saw them, the ones before and the pairs so often."""
        alone = (words + ADDED) / (self.total + ADDED * (self.size + 1))  # one more: words that nobody has seen
        given = np.where(before > 0, pairs / np.maximum(before, 1), 0)
        weight = np.where(before > 0, BIGRAM, 0.0)
        return -np.log2(weight * given + (1 - weight) * alone)


def count_model(packs: DataFrame, size: int) -> Model:
    """The model of packs that hold `size` distinct words."""
    sizes = HOT, HOT, HOT * HOT, 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((n, 2), dtype=np.int64) for n in sizes]
        words, before, hot, total = tables
        for batch in batches:
            for _, pack in _packs(batch):
                for k in (0, 1):
                    own = pack.target[pack.owner] == (k == 0)
                    a, b = pack.before[own], pack.words[own]
                    words[:, k] += np.bincount(b[b < HOT], minlength=HOT)
                    before[:, k] += np.bincount(a[a < HOT], minlength=HOT)
                    both = (a < HOT) & (b < HOT)
                    hot[:, k] += np.bincount(a[both] * HOT + b[both], minlength=HOT * HOT)
                    total[0, k] += len(b)
        for kind, table in enumerate(tables):
            some = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), kind, np.int32)), pa.array(some),
                    pa.array(table[some, 0]), pa.array(table[some, 1]),
                ],
                ["kind", "place", "target", "rest"],
            )

    schema = "kind int, place long, target long, rest long"
    sums = packs.select("uid", "sizes", "target", "known", "words").mapInArrow(scan, schema).groupBy("kind", "place")
    table = sums.agg(F.sum("target").alias("target"), F.sum("rest").alias("rest")).toArrow()  # the sizes of `scan`
    parts = [np.zeros((n, 2)) for n in sizes]
    kinds, place = table["kind"].to_numpy(), table["place"].to_numpy()
    for kind, part in enumerate(parts):
        own = kinds == kind
        part[place[own], 0] = table["target"].to_numpy()[own]
        part[place[own], 1] = table["rest"].to_numpy()[own]
    return Model(*parts, size)


_COUNTS = "uid long, part int, pairs binary, singles binary, seen binary, alone binary"
_COUNT_NAMES = ["uid", "part", "pairs", "singles", "seen", "alone"]


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], _COUNT_NAMES)


def _sums(hashes: list[bytes], counts: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For runs of hashes with `width` counts each: the runs, their distinct hashes, the place of each
    hash among these, and the sums (exact to 2**53)."""
    runs = [unsqueezed(h) for h in hashes]
    own = np.concatenate([unsqueezed_counts(c, width) for c in counts])
    distinct, place = np.unique(np.concatenate(runs), return_inverse=True)
    sums = np.stack([np.bincount(place, own[:, k], len(distinct)) for k in range(width)], axis=1).astype(np.int64)
    return runs, distinct, place, sums


def _added_up(hashes: list[bytes], counts: list[bytes], width: int) -> list[bytes]:
    """For runs of hashes with `width` counts each, the same runs' sums over all of them."""
    runs, _, place, sums = _sums(hashes, counts, width)
    ends = np.cumsum([len(run) for run in runs]).tolist()
    return [squeezed_counts(sums[place[x:y]]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def _emitted(uid: int, parts: int, pairs: np.ndarray, known: np.ndarray, seen: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
    """A row for each part that has some of the sorted hashes, with their counts."""
    found = np.concatenate([_ranges(pairs, parts), _ranges(known, parts)])
    first, last = (int(found.min()), int(found.max())) if len(found) else (0, 0)
    x, y = _cuts(pairs, parts, first, last), _cuts(known, parts, first, last)
    return _counts(
        [
            (
                uid, p, squeezed(pairs[a:b]), squeezed(known[c:d]),
                squeezed_counts(seen[a:b]), squeezed_counts(alone[c:d]),
            )
            for p, (a, b, c, d) in enumerate(zip(x[:-1], x[1:], y[:-1], y[1:], strict=True), first)
            if a < b or c < d
        ]
    )


def _of_packs(parts: int):
    """The counts of each pack by parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, pack in _packs(batch):
                marks = [pack.target[pack.owner] == mark for mark in (True, False)]
                pairs, place = pack.rare_pairs()
                rare = ~pack.hot
                seen = np.stack([np.bincount(place, m[rare], len(pairs)) for m in marks], axis=1)
                size = HOT + len(pack.known)
                alone = [np.bincount(x, m, size)[HOT:] for x in (pack.words, pack.before) for m in marks]
                seen, alone = seen.astype(np.int64), np.stack(alone, axis=1).astype(np.int64)
                yield _emitted(uid, parts, pairs, pack.known, seen, alone)

    return scan


def _of_runs(parts: int):
    """The counts of each id's runs, added up, by parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["id"], SLAB):
            ids = table.column("id").to_pylist()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = table.slice(low, high - low)
                pairs, singles, seen, alone = (own.column(c).to_pylist() for c in _COUNT_NAMES[2:])
                _, pairs, _, seen = _sums(pairs, seen, 2)
                _, known, _, alone = _sums(singles, alone, 4)
                yield _emitted(ids[low], parts, pairs, known, seen, alone)

    return scan


def _back_to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id's runs, then its sums by part: the runs with these sums."""
    for table, bounds in whole_groups(batches, ["id"], SLAB):
        is_sum = table.column("is_sum").to_numpy()
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            cut = low + int(np.count_nonzero(~is_sum[low:high]))
            runs, sums = table.slice(low, cut - low), table.slice(cut, high - cut)
            out = []
            for name, of, width in (("pairs", "seen", 2), ("singles", "alone", 4)):
                own = [unsqueezed(h) for h in runs.column(name).to_pylist()]
                distinct = np.unique(np.concatenate(own))
                total = _joined(sums.column(of).to_pylist(), width)
                out.append([squeezed_counts(total[np.searchsorted(distinct, run)]) for run in own])
            uids, parts = runs.column("uid").to_pylist(), runs.column("part").to_pylist()
            yield _counts([(u, p, None, None, x, y) for u, p, x, y in zip(uids, parts, *out, strict=True)])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each part, for the rows that sent counts."""
    for table, bounds in whole_groups(batches, ["part"], SLAB):
        uids, of = table.column("uid").to_pylist(), table.column("part").to_pylist()
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = table.slice(low, high - low)
            pairs, singles, seen, alone = (own.column(c).to_pylist() for c in _COUNT_NAMES[2:])
            seen, alone = _added_up(pairs, seen, 2), _added_up(singles, alone, 4)
            yield _counts([(u, of[low], None, None, x, y) for u, x, y in zip(uids[low:high], seen, alone, strict=True)])


def _added(counts: DataFrame) -> DataFrame:
    return counts.repartition("part").sortWithinPartitions("part", "uid").mapInArrow(_add, _COUNTS)


def pair_counts(packs: DataFrame, parts: int) -> DataFrame:
    """uid, part, seen, alone: for each pack's distinct rare pairs of a part, in order, how often target and
    background documents of the whole corpus hold them (two numbers each); for its words that are not
    hot, how often both hold them and have them before another word (four).

    More than MOST_PARTS are reached in two dealings: the runs that packs send to a coarse part are added up in
    shares of about a part's size, these are dealt to the fine parts, and their sums go back to the runs.
    """
    coarse = min(parts, MOST_PARTS)
    sent = packs.select("uid", "sizes", "target", "known", "words").mapInArrow(_of_packs(coarse), _COUNTS)
    if parts == coarse:
        return _added(sent).drop("pairs", "singles")
    shares = -(-parts // coarse)
    share = F.col("part").cast("long") * shares + F.pmod(F.xxhash64("uid"), F.lit(shares))
    runs = written(sent.withColumn("id", share), "runs")
    by_id = runs.repartition("id").sortWithinPartitions("id", "uid")
    sums = _added(by_id.mapInArrow(_of_runs(parts), _COUNTS)).withColumn("id", F.col("uid"))
    both = runs.withColumns({"seen": F.lit(None).cast("binary"), "alone": F.lit(None).cast("binary"), "is_sum": F.lit(False)})
    both = both.unionByName(sums.withColumn("is_sum", F.lit(True)))
    back = both.repartition("id").sortWithinPartitions("id", "is_sum", "part", "uid")
    return back.mapInArrow(_back_to_runs, _COUNTS).drop("pairs", "singles")


def _joined(counts: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([np.empty((0, width), np.int64), *(unsqueezed_counts(c, width) for c in counts)])


def scored(packs: DataFrame, model: Model, parts: int) -> DataFrame:
    """doc_id, tie, n_words, target_bits, rest_bits (sums over the words) of the documents of packs."""
    shared = packs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table, bounds in whole_groups(batches, ["uid"], SLAB):
            seen, alone = table.column("seen").to_pylist(), table.column("alone").to_pylist()
            heads = table.take(pa.array(bounds[:-1]))  # a pack comes first, then its counts by part
            for (_, pack), low, high, k in zip(
                _packs(heads), bounds[:-1].tolist(), bounds[1:].tolist(), range(len(heads)), strict=True
            ):
                _, place = pack.rare_pairs()
                held = np.empty((len(pack.words), 2))
                hot = pack.hot
                held[hot] = model.hot[pack.before[hot] * HOT + pack.words[hot]]
                held[~hot] = _joined(seen[low + 1 : high], 2)[place]
                rest = _joined(alone[low + 1 : high], 4)
                words = np.concatenate([model.words, rest[:, :2]])[pack.words]
                loss = model.loss(words, np.concatenate([model.before, rest[:, 2:]])[pack.before], held)
                sums = [np.bincount(pack.owner, loss[:, m], len(pack.target)).astype(float) for m in (0, 1)]
                docs, ties, sizes = (heads.column(c)[k].values for c in ("doc_id", "tie", "sizes"))
                yield pa.RecordBatch.from_arrays(
                    [docs, ties, sizes.cast(pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                    ["doc_id", "tie", "n_words", "target_bits", "rest_bits"],
                )

    none = F.lit(None)
    counted = written(pair_counts(packs, parts), "pair_counts").select(
        "uid", "part", *(none.cast(packs.schema[c].dataType).alias(c) for c in _PACK_NAMES[1:]), "seen", "alone"
    )
    no_counts = [none.cast("binary").alias(c) for c in ("seen", "alone")]
    whole = packs.select("uid", F.lit(-1).alias("part"), *_PACK_NAMES[1:], *no_counts)
    return (
        whole.unionByName(counted)
        .repartition("uid")
        .sortWithinPartitions("uid", "part")
        .mapInArrow(finish, "doc_id long, tie long, n_words long, target_bits double, rest_bits double")
    )


def pack_words(parts: int) -> int:
    """Words of a pack: enough pairs for each part that it is dealt to."""
    return max(PACK_WORDS, PACK_PAIRS * min(parts, MOST_PARTS))


def score_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of every document.

    targets: the doc_id of the target documents; repeated ones count once, unknown and null ones not at
    all. Losses are in bits a word. A null or empty text has null losses. Repeated rows count each. If a
    model has no words, all words are equally likely under it.
    """
    spark = documents.sparkSession
    chosen = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    flags = chosen.withColumn("target", F.lit(True))
    if chosen.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS:
        flags = F.broadcast(flags)
    marked = rows.join(flags, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    with short_lived_tables(spark), settings(spark, {BATCH_BYTES: str(BATCH), TABLE_CODEC: "zstd"}):
        hot, size, total = vocabulary(documents)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
        # Sorted, so that packs are the same if a task is run again.
        packs = packed(marked.sortWithinPartitions("doc_id", "tie"), pack_words(parts), hot)
        packs = written(packs, "packs")
        sums = written(scored(packs, count_model(packs, size), parts), "scores", kept=True)
    mean = [F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")) for c in ("target_bits", "rest_bits")]
    return sums.select(
        "doc_id", "n_words", mean[0].alias("target_loss"), mean[1].alias("background_loss"),
        (mean[0] - mean[1]).alias("score"),
    )
