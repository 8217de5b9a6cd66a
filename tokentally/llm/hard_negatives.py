"""Operator 12: hard negatives by cover trees.

1. Vectors become whole numbers, so products are exact.
2. A bounded sample of them gives centres; every vector goes to the cell of its nearest centre, and cells
   are dealt into pages of bounded size, so a cell with a third of all rows is many pages. Each page
   is built into a cover tree (`cover_tree`) once and stored.
3. A search (`searched`) has windows of products for each query. The sample's own vectors, which are rows
   like others, give first bounds. A query visits the cells whose covering angle lets them hold
   something within a window and above its bound; each page returns a few of its best; the best of all
   pages are the answer. So only vectors that cannot be part of it are left unseen.
4. Positives are one such search (the anchor's label, any product), negatives a second one (other
   labels, a window for each positive that follows from its product).

A page that very many queries visit is copied to several tasks, each with a share of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import written
from .cover_tree import PACKED, Found, Tree, Windows, angles, bounds, compared, directions, farthest_first, norms
from .groups import whole_groups
from .texts import mix
from .vectors import finite_by_width

STEPS = 256
#: Vectors with an entry beyond this (after scaling) are taken as non-finite: their products are no longs.
LARGEST = 2.0**22
POSITIVES = 5
NEGATIVES = 3
#: A negative's product, in per cent of the positive's.
RANGE = (50, 95)
#: Bytes of vectors of a page, and vectors of it at most.
PAGE_BYTES = 1 << 20
PAGE_ROWS = 4096
#: Cells at most; beyond, they get more pages each. Vectors and bytes of the sample, at most.
CELLS = 1024
SAMPLE = 8192
SAMPLE_BYTES = 8 << 20
#: Queries that one copy of a page serves, about, and queries handled at once.
SERVED = 16_384
QUERIES = 256
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def whole_vectors(rows: DataFrame) -> DataFrame:
    """uid, vec_id, label, size, vector (32-bit numbers), length of the rows that take part; written.

    Those are rows without nulls whose vector holds finite numbers only. All have the length that most
    of them have (of equals the larger one); others take no part.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, matrix in finite_by_width(batch.column(2)):
                numbers = np.floor(STEPS * matrix)
                near = (np.abs(numbers) <= LARGEST).all(axis=1)
                numbers, some = numbers[near].astype(np.int32), pa.array(some[near])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(some), batch.column(1).take(some),
                        pa.array(np.full(len(numbers), numbers.shape[1], np.int32)),
                        pa.array([v.tobytes() for v in numbers], pa.binary()), pa.array(norms(numbers)),
                    ],
                    ["vec_id", "label", "size", "vector", "length"],
                )

    known = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    schema = "vec_id long, label long, size int, vector binary, length double"
    found = known.mapInArrow(scan, schema).withColumn("uid", F.monotonically_increasing_id())
    found = written(found, "vectors")
    best = found.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.where(F.col("size") == (best["size"] if best else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a binary column without nulls."""
    content = b"".join(column.to_pylist())
    return np.frombuffer(content, np.int32).reshape(-1, width)


@dataclass(frozen=True)
class Cells:
    """Centres of cells as directions; the largest angle and the range of labels of what each covers (none:
    highest below lowest); its first page (and the end). Vectors, labels and ids of the sample."""

    longest: float
    centres: np.ndarray
    angle: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1] - 1

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its angle to the centre."""
        cosines = directions(vectors, self.longest) @ self.centres.T
        cell = cosines.argmax(axis=1)
        return cell, angles(cosines[np.arange(len(cell)), cell])

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product of each vector with what a cell covers."""
        scores = vectors @ self.centres[:, :-1].T * self.longest
        return bounds(scores, norms(vectors), self.longest, self.angle)


def _sampled(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Vectors, labels and ids of the rows with the smallest hashes: a bounded number of bytes; the length
    of vectors."""
    size = rows.select("size").first()["size"]
    count = max(64, min(SAMPLE, SAMPLE_BYTES // (4 * size)))
    chosen = rows.orderBy(F.xxhash64("uid"), "uid").limit(count).select("vector", "label", "vec_id").toArrow()
    chosen = chosen.combine_chunks()
    ids = (chosen.column(c).to_numpy() for c in ("label", "vec_id"))
    return (_matrix(chosen.column("vector"), size), *ids), size


def cells_of(rows: DataFrame) -> Cells | None:
    """Centres and numbers of pages of the cells; None without rows. `pages_of` tells what they cover."""
    count, longest = rows.agg(F.count(F.lit(1)), F.max("length")).first()
    if not count:
        return None
    sample, width = _sampled(rows)
    longest = max(longest, 1.0)
    page = max(64, min(PAGE_ROWS, PAGE_BYTES // (4 * width)))
    units = directions(sample[0], longest)
    places, _, _ = farthest_first(units, min(CELLS, -(-count // page), len(units)))
    none = np.zeros(len(places))
    first = np.arange(len(places) + 1)
    draft = Cells(longest, units[places], none, none, none - 1, first, sample)
    shared = rows.sparkSession.sparkContext.broadcast(draft)  # SAMPLE_BYTES and CELLS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        n = np.zeros(len(cells.centres), np.int64)
        for batch in batches:
            cell, _ = cells.nearest(_matrix(batch.column(0), cells.width))
            n += np.bincount(cell, minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["cell", "n"])

    parts = rows.select("vector").mapInArrow(scan, "cell long, n long")
    table = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS
    n = np.ones(len(places), np.int64)
    n[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return replace(draft, first=np.cumsum([0, *(-(-n // page))]))


_COVERED = "cell int, reach double, lowest long, highest long"
_PAGE = "page long, size int, longest double, " + ", ".join(f"{n} binary" for n in PACKED if n != "longest")
_PAGE_NAMES = ["page", "size", "longest", *(n for n in PACKED if n != "longest")]


def pages_of(rows: DataFrame, cells: Cells) -> tuple[DataFrame, Cells]:
    """A row for each page with its packed tree, written; and the cells with what they cover.

    Pages of a cell hold its vectors by hash. What a cell covers is read from its pages, so it holds for
    what is in them, even where rounding puts a vector that lies between two centres into either.
    """
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            cell, _ = cells.nearest(_matrix(batch.column(3), cells.width))
            parts = np.diff(cells.first)[cell].astype(np.uint64)
            page = cells.first[cell] + (mix(batch.column(0).to_numpy()) % parts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page), *batch.columns], ["page", "uid", "vec_id", "label", "vector"]
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value.width
        for table, at in whole_groups(batches, ["page"], PAGE_BYTES):
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = table.slice(low, high - low)
                labels, ids = (own.column(c).to_numpy() for c in ("label", "vec_id"))
                vectors = _matrix(own.column("vector"), width)
                tree = Tree.of(vectors, labels, ids)
                page = own.column("page")[0].as_py()
                cell = int(np.searchsorted(shared.value.first, page, "right")) - 1
                centre = shared.value.centres[cell]
                reach = angles(directions(vectors, shared.value.longest) @ centre).max()
                known = {"cell": cell, "reach": reach, "lowest": labels.min(), "highest": labels.max()}
                row = known | {"page": page, "size": width} | tree.packed()
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in kinds], schema=kinds)

    schema = f"{_COVERED}, {_PAGE}"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    dealt = rows.select("uid", "vec_id", "label", "vector").mapInArrow(
        deal, "page long, uid long, vec_id long, label long, vector binary"
    )
    built = dealt.repartition("page").sortWithinPartitions("page", "uid").mapInArrow(build, schema)
    pages = written(built, "pages")
    covered = pages.groupBy("cell").agg(F.max("reach"), F.min("lowest"), F.max("highest")).toArrow()  # CELLS
    at, *values = (c.to_numpy() for c in covered.columns)
    angle, low, high = np.zeros(len(cells.centres)), np.zeros(len(cells.centres), np.int64), np.full(len(cells.centres), -1)
    angle[at], low[at], high[at] = values
    return pages, replace(cells, angle=angle, low=low, high=high)


_QUERY = "uid long, vec_id long, label long, vector binary, least array<long>, most array<long>"
_QUERY_NAMES = ["uid", "vec_id", "label", "vector", "least", "most"]
_FOUND = "uid long, window int, id long, score long"


def _windows(batch: pa.RecordBatch, width: int) -> Windows:
    """Of rows with the columns of _QUERY."""
    least, most = (batch.column(c) for c in ("least", "most"))
    counts = np.diff(least.offsets.to_numpy())
    return Windows(
        _matrix(batch.column("vector"), width), batch.column("label").to_numpy(), batch.column("vec_id").to_numpy(),
        np.repeat(np.arange(batch.num_rows), counts), least.flatten().to_numpy(), most.flatten().to_numpy(),
    )


def _visits(queries: DataFrame, cells: Cells, want: int, same: bool) -> DataFrame:
    """The queries with raised bounds and the cells that each must visit; written."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(first, QUERIES)
                windows = _windows(batch, cells.width)
                hits = list(compared(windows, np.arange(len(windows.query)), windows.least, cells.sample, same))
                raised = Found.none(want).with_more(hits).raised(windows.least)
                low, high = cells.bounds(windows.vectors)
                labels = windows.labels[:, None]
                if same:
                    fits = (cells.low <= labels) & (labels <= cells.high)
                else:
                    fits = ~((cells.low == labels) & (cells.high == labels))
                own = windows.query
                inside = (high[own] >= raised[:, None]) & (low[own] <= windows.most[:, None])
                inside &= (windows.least <= windows.most)[:, None] & (cells.low <= cells.high)
                visited = np.zeros(fits.shape, bool)
                np.logical_or.at(visited, own, inside)
                row, cell = np.nonzero(visited & fits)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                # Offsets of a slice start anywhere; the arrays made anew start at 0.
                starts = np.concatenate([[0], np.cumsum(np.diff(batch.column("least").offsets.to_numpy()))])
                starts = pa.array(starts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in _QUERY_NAMES[:4]),
                        pa.ListArray.from_arrays(starts, pa.array(raised)),
                        pa.ListArray.from_arrays(starts, pa.array(windows.most)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(cell, pa.int32())),
                    ],
                    [*_QUERY_NAMES, "cells"],
                )

    return written(queries.select(*_QUERY_NAMES).mapInArrow(scan, _QUERY + ", cells array<int>"), "visits")


def searched(pages: DataFrame, cells: Cells, queries: DataFrame, want: int, same: bool) -> DataFrame:
    """uid, window, rank, id, score: for each window of each query the `want` best vectors, by product and
    then by id; of the query's own label with `same`, else of other labels.

    queries: uid, vec_id, label, vector, and `least` and `most`, arrays with the bounds of its windows.
    """
    spark = pages.sparkSession
    visits = _visits(queries, cells, want, same)
    by_cell = visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()  # CELLS
    slots = [
        (r["cell"], int(cells.first[r["cell"]]), int(cells.first[r["cell"] + 1]) - 1, -(-r["count"] // SERVED))
        for r in by_cell
    ]
    layout = F.broadcast(spark.createDataFrame(slots, "cell int, from_page long, to_page long, slots long"))  # CELLS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for whole in batches:
            page, slot = (whole.column(c).to_numpy() for c in ("page", "slot"))
            changes = np.flatnonzero((np.diff(page) != 0) | (np.diff(slot) != 0)) + 1
            edges = [0, *changes.tolist(), whole.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if at != (page[start], slot[start]):
                    # A group starts with its page; a page may hold no vector, then it is not there.
                    tree, at = None, (page[start], slot[start])
                    if not whole.column("uid")[start].is_valid:
                        row = {n: whole.column(n)[start].as_py() for n in _PAGE_NAMES}
                        tree, start = Tree.unpacked(row, row["size"]), start + 1
                if tree is None:
                    continue
                for first in range(start, end, QUERIES):
                    batch = whole.slice(first, min(QUERIES, end - first))
                    windows = _windows(batch, tree.vectors.shape[1])
                    found = tree.search(windows, want, same)
                    query = windows.query[found.window]
                    place = found.window - np.searchsorted(windows.query, query)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("uid").take(pa.array(query)), pa.array(place, pa.int32()),
                            pa.array(found.id), pa.array(found.score),
                        ],
                        ["uid", "window", "id", "score"],
                    )

    def absent(schema: str) -> list[Column]:
        return [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))]

    copies = pages.join(layout, "cell").select(
        F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), *_PAGE_NAMES, *absent(_QUERY)
    )
    asked = (
        visits.select(*_QUERY_NAMES, F.explode("cells").alias("cell"))
        .join(layout, "cell")
        .select(
            F.pmod(F.xxhash64("uid"), F.col("slots")).alias("slot"),
            F.explode(F.sequence("from_page", "to_page")).alias("page"), *_QUERY_NAMES,
        )
    )
    asked = asked.select("slot", "page", *absent(_PAGE)[1:], *_QUERY_NAMES)
    met = copies.unionByName(asked).repartition("page", "slot").sortWithinPartitions("page", "slot", F.col("uid").asc_nulls_first())
    found = met.mapInArrow(search, _FOUND)
    rank = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= want)


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = RANGE[0],
    most: int = RANGE[1],
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, label, embedding. `anchor` is a condition on vec_id and label that chooses the
    anchors. An anchor's positives are its first other rows of the same label; the negatives of a positive
    are the first rows of other labels with least * positive_score <= 100 * negative_score <= most *
    positive_score. First: by product with the anchor, then by smaller vec_id.

    Rows with a null vec_id or label, a vector that is null or empty or holds nulls or non-finite numbers
    (or numbers beyond LARGEST), or a vector of another length than most have, take no part. Rows that
    repeat a vec_id count each, as anchors and as candidates, but are no candidates of one another. An anchor
    without positives, or a positive without negatives, has no row. A zero vector has product 0 with
    all. An empty table gives an empty one. Columns with other names are not looked at.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    cells = cells_of(rows)
    if cells is None:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    pages, cells = pages_of(rows, cells)
    anchors = rows.where(anchor).select("uid", "vec_id", "label", "vector")
    everything = [F.array(F.lit(x).cast("long")).alias(n) for x, n in ((LOWEST, "least"), (HIGHEST, "most"))]
    chosen = written(searched(pages, cells, anchors.select("*", *everything), positives, True), "positives")

    def hundredth(percent: int) -> Column:
        """floor(percent * score / 100) of each score."""
        return F.expr(f"transform(scores, s -> (s * {percent} - pmod(s * {percent}, 100)) div 100)")

    lists = chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("held"))
    lists = lists.select("uid", F.col("held.score").alias("scores"))  # `positives` each
    lowest = F.transform(hundredth(-least), lambda s: -s)
    asked = anchors.join(lists, "uid").select("uid", "vec_id", "label", "vector", lowest.alias("least"), hundredth(most).alias("most"))
    found = searched(pages, cells, asked, negatives, False)
    return (
        found.select("uid", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(chosen.select("uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["uid", "place"])
        .join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
