"""Operator 5: near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Words are lower-cased (A-Z), a document's set holds the distinct shingles of five words, and documents
with Jaccard similarity of 0.85 or more are linked. Callers may ask for another similarity, with the
distance bound that fits it; the numbers below are those of 0.85.

1. Each document gets its set's size, its 128-bit key and a signature of 64 symbols of 16 bits.
   Documents with one set are one node from here on, so copies are never paired.
2. Two sets of similarity 0.85 differ in 9.6 of 64 symbols on average, and in more than 21 (the
   distance bound) with a chance of about 1 in 10,000. The symbols are split into 11 chunks: 21 errors
   cannot put two into each, so some chunk has one error at most. Each chunk is indexed once for every
   symbol left out, which enumerates the allowed errors: any pair within the bound shares a key.
3. The nodes of a key are dealt into cells of two blocks, which compare all signatures in numpy. A pair
   counts in the cell of its first common key only. No pair leaves a cell: its nodes do.
4. Cells get the whole sets of these nodes, compute exact similarities, and return links that connect
   the same nodes (a forest), so the number of rows stays proportional to the nodes.
5. Components of the links give each document the smallest document it can reach.

Shingles are 64-bit hashes; sets are told apart by 128 bits, and the nodes of distinct sets are numbered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .groups import Forest, components, pairs_within, whole_groups
from .texts import Powers, chunks, constants, mix, rolling_hash

SHINGLE = 5
SIMILAR = 85  # per cent
SYMBOLS = 64
DISTANCE = 21
#: Nodes of a block; a cell compares two blocks at most.
BLOCK = 256
#: Pairs compared at once.
PAIRS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Similarity in per cent that links documents, and the errors of signatures within which they are sought."""

    similar: int = SIMILAR
    distance: int = DISTANCE

    @property
    def edges(self) -> np.ndarray:
        """Where chunks begin, and the end: as many as cannot all have two errors."""
        return np.linspace(0, SYMBOLS, self.distance // 2 + 2).astype(int)

    @property
    def chunk_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))


RULE = Rule()
_SHINGLES = Powers(31)
_FLIP = (constants(32, SYMBOLS) >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = ((constants(33, SYMBOLS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
_CHUNK_SEEDS = constants(34, SYMBOLS)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    found = rolling_hash(hashes, width, _SHINGLES) + np.uint64(SHINGLE - width)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(found: np.ndarray) -> np.ndarray:
    """For each of 64 orders of the shingles, the low 16 bits of the first one."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(24)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(low, ((short[k : k + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    return low.astype(np.uint16)


def _set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of two hashes of its elements."""
    one = mix(found).sum(dtype=np.uint64)
    two = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    size = np.uint64(len(found))
    high, low = mix(np.array([one + size, two ^ one], dtype=np.uint64)).view(np.int64)
    return int(high), int(low)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for chunk in chunks(column, lower=True):
        hashes = chunk.hashes()
        for low, high in zip(chunk.bounds[:-1], chunk.bounds[1:], strict=True):
            yield shingles(hashes[low:high])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, tie, n_shingles, high, low, signature of every document.

    (high, low) is the key of its set; they and the signature are null without words.
    tie is a hash of the text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, highs, lows, signs = [], [], [], []
            for found in _sets(batch.column(2)):
                sizes.append(len(found))
                high, low = _set_key(found) if len(found) else (None, None)
                highs.append(high)
                lows.append(low)
                signs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()),
                 pa.array(lows, pa.int64()), pa.array(signs, pa.binary())],
                ["doc_id", "tie", "n_shingles", "high", "low", "signature"],
            )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text"
    ).mapInArrow(scan, "doc_id long, tie long, n_shingles long, high long, low long, signature binary")


def _symbols(column: pa.Array) -> np.ndarray:
    """Signatures as rows of symbols."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, content = column.buffers()
    first = np.frombuffer(places, kind)[column.offset] if len(column) else 0
    flat = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    return flat[first : first + 2 * SYMBOLS * len(column)].view(np.uint16).reshape(-1, SYMBOLS)


def chunk_keys(symbols: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """For each signature and symbol, a key of that symbol's chunk with the symbol left out."""
    parts = mix(symbols.astype(np.uint64) + _CHUNK_SEEDS)
    whole = np.add.reduceat(parts, rule.edges[:-1], axis=1)
    return mix(whole[:, rule.chunk_of] - parts + _CHUNK_SEEDS)


def _keys(rule: Rule):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                keys = chunk_keys(_symbols(part.column(1)), rule)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int32), part.num_rows)),
                        pa.array(np.repeat(part.column(0).to_numpy(), SYMBOLS)),
                    ],
                    ["key", "symbol", "node"],
                )

    return scan


def close_pairs(
    symbols: np.ndarray, a: np.ndarray, b: np.ndarray, symbol: np.ndarray, rule: Rule = RULE
) -> np.ndarray:
    """Which pairs are within the distance and meet under their first common key, that of `symbol`."""
    wrong = symbols[a] != symbols[b]
    near = np.flatnonzero(np.count_nonzero(wrong, axis=1) <= rule.distance)
    wrong = wrong[near]
    edges, chunk_of = rule.edges, rule.chunk_of
    errors = np.add.reduceat(wrong.astype(np.int8), edges[:-1], axis=1)
    chunk = np.argmax(errors <= 1, axis=1)
    rows = np.arange(len(near))
    spot = np.argmax(wrong & (chunk_of[None, :] == chunk[:, None]), axis=1)
    first = np.where(errors[rows, chunk] == 0, edges[chunk], spot)
    result = np.zeros(len(a), dtype=bool)
    result[near] = first == symbol[near]
    return result


_CELL = ["key", "i", "j"]


def _pairs(table: pa.Table, bounds: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each cell that cells must check, as row numbers."""
    symbols = _symbols(table.column("signature"))
    i, j, block, symbol = (table.column(c).to_numpy() for c in ("i", "j", "block", "symbol"))
    for a, b in pairs_within(bounds, PAIRS):
        right = (i[a] == j[a]) | (block[a] != block[b])
        a, b = a[right], b[right]
        close = close_pairs(symbols, a, b, symbol[a], rule)
        yield a[close], b[close]


def _with_pairs(rule: Rule):
    """The rows of cells that have a pair to check."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _CELL):
            used = np.zeros(table.num_rows, dtype=bool)
            for a, b in _pairs(table, bounds, rule):
                used[a] = used[b] = True
            if used.any():
                yield from table.filter(pa.array(used)).to_batches()

    return scan


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similar: int) -> np.ndarray:
    """Whether each pair of sets reaches the similarity, computed on the shingles that two sets share."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = np.cumsum(times > 1) - 1
    owner, place = owner[shared], column[place[shared]]
    width, common = int((times > 1).sum()), np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    step = max(1, (8 << 20) // max(1, len(sets)))
    for low in range(0, width, step):
        x, y = np.searchsorted(place, [low, low + step])
        part = np.zeros((len(sets), min(step, width - low)), dtype=np.float32)
        part[owner[x:y], place[x:y] - low] = 1
        common += part @ part.T  # whole numbers below 2**24: exact
    both = common[a, b]
    return 100 * both >= similar * (sizes[a] + sizes[b] - both)


def _links(rule: Rule):
    """Links that connect the nodes of each cell as far as similar pairs do."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _CELL):
            nodes = table.column("node").to_numpy()
            content = table.column("shingles").combine_chunks()
            found: dict[int, tuple[list, list]] = {}
            for a, b in _pairs(table, bounds, rule):
                group = np.searchsorted(bounds, a, "right") - 1
                cuts = np.flatnonzero(np.diff(group)) + 1
                for g, x, y in zip(group[np.append(0, cuts)] if len(a) else [], np.split(a, cuts), np.split(b, cuts)):
                    one, two = found.setdefault(int(g), ([], []))
                    one.append(x)
                    two.append(y)
            left, right = [], []
            for g, (one, two) in found.items():
                a, b = np.concatenate(one) - bounds[g], np.concatenate(two) - bounds[g]
                used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                a, b = back[: len(a)], back[len(a) :]
                sets = [np.frombuffer(content[int(bounds[g] + k)].as_buffer(), np.uint64) for k in used]
                fits = _similar(sets, a, b, rule.similar)
                forest = Forest(len(used))
                own = nodes[bounds[g] + used]
                for x, y in zip(a[fits].tolist(), b[fits].tolist(), strict=True):
                    if forest.join(x, y):
                        left.append(own[x])
                        right.append(own[y])
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(left, np.int64)), pa.array(np.array(right, np.int64))], ["a", "b"]
                )

    return scan


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """node and shingles (64-bit numbers one after another) of rows node, high, low, text whose text has the key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, content, size = [], [], 0
            *keys, texts = batch.columns
            for node, high, low, found in zip(*(k.to_pylist() for k in keys), _sets(texts), strict=True):
                if len(found) and _set_key(found) == (high, low):
                    nodes.append(node)
                    content.append(found.tobytes())
                    size += len(content[-1])
                if size > 16 << 20:
                    yield _set_rows(nodes, content)
                    nodes, content, size = [], [], 0
            yield _set_rows(nodes, content)

    return texts.select("node", "high", "low", "text").mapInArrow(scan, "node long, shingles binary")


def _set_rows(nodes: list[int], content: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(content, pa.binary())], ["node", "shingles"]
    )


def _cells(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Rows key, i, j, block, symbol, node, signature: the nodes of each key that has two, by cells."""
    keys = nodes.select("node", "signature").mapInArrow(_keys(rule), "key long, symbol int, node long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        keys.join(sizes, "key")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .join(nodes.select("node", "signature"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "symbol", "node", "signature",
        )
    )


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "node")


def set_nodes(prints: DataFrame) -> DataFrame:
    """node (a number of its own), high, low, signature, smallest (doc_id) and one of its documents (of, of_tie)
    for each distinct set."""
    one = F.min(F.struct("doc_id", "tie")).alias("one")
    sets = prints.where("low is not null").groupBy("high", "low", "signature").agg(one, F.min("doc_id").alias("smallest"))
    return written(
        sets.select(
            F.monotonically_increasing_id().alias("node"), "high", "low", "signature", "smallest",
            F.col("one.doc_id").alias("of"), F.col("one.tie").alias("of_tie"),
        ),
        "nodes",
    )


def similar_links(documents: DataFrame, nodes: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Links (a, b) between nodes that connect all nodes of similar documents."""
    columns = "key long, i int, j int, block int, symbol int, node long, signature binary"
    close = written(_by_cell(_cells(nodes, rule)).mapInArrow(_with_pairs(rule), columns), "cells")
    chosen = nodes.join(close.select("node").distinct(), "node", "left_semi")
    chosen = chosen.select("node", "high", "low", "of", "of_tie")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")))
    sets = _shingle_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles"))
    return _by_cell(close.join(sets, "node")).mapInArrow(_links(rule), "a long, b long")


def near_duplicates(documents: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, tie, n_shingles, component_id, kept, node, group of every document.

    component_id is the smallest doc_id that links reach; kept: doc_id = component_id. A null or
    empty text has no shingles and is linked with nothing. Rows of one doc_id with different texts
    are documents of their own. A null doc_id can be linked, but is never the smallest. node is the
    number of the document's set, group that of its component; both are null without words.
    """
    prints = written(fingerprints(documents), "fingerprints")
    nodes = set_nodes(prints)
    found = components(similar_links(documents, nodes, rule))
    linked = found.join(nodes.select("node", "smallest"), "node")
    lowest = linked.groupBy("component").agg(F.min("smallest").alias("component_id"))
    # Written, so that the nodes of a very large component meet its one row in a join that Spark may split.
    of_node = found.join(written(lowest, "lowest"), "component")
    of_set = nodes.join(of_node, "node", "left").select(
        "high", "low", "node", F.coalesce("component", "node").alias("group"),
        F.when(F.col("component").isNull(), F.col("smallest")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return (
        prints.drop("signature")
        .join(of_set, ["high", "low"], "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "tie", "n_shingles", "component_id", "kept", "node", "group")
    )


def without_near_duplicates(documents: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One document of each group, with all its columns.

    That is the one with the smallest doc_id (null after all others); of several rows with this doc_id, the
    one whose text hash is smallest, and one of exactly repeated rows. Rows without words all stay.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie"))
    kept = (
        near_duplicates(documents, rule)
        .where("node is not null")
        .groupBy("group")
        .agg(first.alias("first"))
        .select(F.col("first.doc_id").alias("keep_id"), F.col("first.tie").alias("keep_tie"))
    )
    rows = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("document"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("tie"),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"),
    )
    worded = rows.where("has_words").join(
        kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie")), "left_semi"
    )
    once = worded.groupBy("id", "tie").agg(F.first("document").alias("document"))
    others = rows.where(~F.col("has_words"))
    return once.select("document.*").unionByName(others.select("document.*"))
