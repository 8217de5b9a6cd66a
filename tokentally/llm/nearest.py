"""Operator 4: nearest neighbours by multiprobe p-stable hashing, largest inner product first.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors, so the
largest inner product is the smallest distance. Each table hashes a vector to a bucket: `functions`
Gaussian projections, each cut into slots of one width. For a query and a neighbour at a given cosine
the chance of each slot is known, so the chance of a bucket is the product over its functions. A query
visits buckets in descending order of it until its tables together hold a neighbour with the wished
probability. Candidates are ranked by exact inner products.

The cosine assumed for the last wanted neighbour is measured on a bounded sample (SAMPLE_QUERIES
queries, SAMPLE_VECTORS vectors); everything else covers all vectors. A query is done if it has found
`count` vectors at that cosine or closer: then all its nearest ones are as close, and each was visited
with the wished probability. The other queries (those in sparser parts, or with few candidates) search
again with a lower cosine measured on them, and what is open after that is compared with all vectors.

How many functions a table has
follows from that cosine and the number of vectors: the closer neighbours are, the more functions fit
into the wished number of visits, and the fewer vectors are looked at. On vectors whose neighbours are
hardly closer than any other vector, most of them must be looked at.

Buckets are grouped by hash into blocks of bounded size; large buckets are dealt over several. A query
goes to the blocks that hold buckets of its, and each block returns at most `count` vectors for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

NEIGHBOURS = 20
TABLES = 4
#: The wished probability that a neighbour at the assumed cosine is visited.
SUCCESS = 0.96
#: Buckets a query visits in a table, about; functions are added up to it.
VISITS = 128
#: Which quantile of the sampled queries' cosines each search assumes; a last one visits all buckets.
QUANTILES = (0.3, 0.1)
SAMPLE_QUERIES = 64
SAMPLE_VECTORS = 4096
#: Bytes of vectors of a block, about.
BLOCK_BYTES = 16 << 20
#: Queries compared at once.
QUERY_ROWS = 512
#: Slots beyond this many standard deviations count with the last one within.
REACH = 4.0


_GRID = np.linspace(-10, 10, 20_001)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def _below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return np.interp(x, _GRID, _NORMAL)


@dataclass(frozen=True)
class Plan:
    """Projections (a row for each function of each table), shifts and slot width."""

    dimension: int
    scale: float
    cosine: float
    functions: int
    width: float
    tables: int
    seed: int = 4

    @property
    def slots(self) -> int:
        return int(2 * math.ceil(REACH / self.width)) + 1

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        chance = np.random.default_rng(self.seed)
        size = self.tables * self.functions
        return chance.standard_normal((size, self.dimension + 1)), chance.uniform(0, self.width, size)

    def _codes(self, slots: np.ndarray) -> np.ndarray:
        """One number for the slots of each table."""
        shape = (len(slots), self.tables, self.functions)
        weights = self.slots ** np.arange(self.functions, dtype=np.int64)
        return (slots.reshape(shape) * weights).sum(axis=2) if self.functions else np.zeros(shape[:2], np.int64)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        unit = vectors / self.scale
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))
        lines, shifts = self.projections()
        values = np.hstack([unit, rest[:, None]]) @ lines.T
        slots = np.floor((values + shifts) / self.width).astype(np.int64) + self.slots // 2
        return self._codes(np.clip(slots, 0, self.slots - 1))

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        """For each query, table and function the chance of each slot for a neighbour."""
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        lines, shifts = self.projections()
        values = unit @ lines[:, :-1].T
        edges = (np.arange(1, self.slots) - self.slots // 2) * self.width - shifts[:, None]
        spread = math.sqrt(1 - self.cosine**2)
        below = _below((edges[None] - self.cosine * values[:, :, None]) / spread)
        ends = np.zeros((*values.shape, 1)), np.ones((*values.shape, 1))
        found = np.diff(np.concatenate([ends[0], below, ends[1]], axis=2), axis=2)
        return found.reshape(len(vectors), self.tables, self.functions, self.slots)

    def visits(self, chances: np.ndarray, share: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For rows of chances (functions x slots): the most likely buckets in order, and which to visit.

        Buckets are built function by function, keeping the `most` likeliest beginnings: a beginning
        that is not among them cannot lead to a bucket that is. The buckets kept are visited until they
        hold `share`; if they don't, more beginnings are kept.
        """
        chance = np.ones((len(chances), 1))
        code = np.zeros((len(chances), 1), dtype=np.int64)
        for k in range(self.functions):
            chance = (chance[:, :, None] * chances[:, k, None, :]).reshape(len(chances), -1)
            code = (code[:, :, None] + np.arange(self.slots) * self.slots**k).reshape(len(chances), -1)
            if chance.shape[1] > most:
                top = np.argpartition(-chance, most - 1, axis=1)[:, :most]
                chance, code = (np.take_along_axis(x, top, axis=1) for x in (chance, code))
        order = np.argsort(-chance, axis=1, kind="stable")
        chance, code = (np.take_along_axis(x, order, axis=1) for x in (chance, code))
        before = np.cumsum(chance, axis=1) - chance
        if chance.shape[1] < self.slots**self.functions and (before[:, -1] + chance[:, -1]).min() < share:
            return self.visits(chances, share, 2 * most)
        return code, before < share

    def share(self) -> float:
        """What each table must hold so that all together reach the wished probability."""
        return 1 - (1 - SUCCESS) ** (1 / self.tables)


def plan(dimension: int, scale: float, cosine: float, vectors: int, count: int) -> Plan:
    """The plan with the most functions whose queries visit about VISITS buckets of a table at most."""
    cosine = min(max(cosine, 0.05), 0.999)
    width = max(0.25, 2 * math.sqrt(1 - cosine**2))
    best = Plan(dimension, scale, cosine, 0, width, 1)
    if vectors <= 4 * count:
        return best  # one bucket: all vectors
    chance = np.random.default_rng(9)
    samples = chance.standard_normal((32, dimension))
    for functions in range(1, min(2 * math.ceil(math.log2(vectors)), 20) + 1):
        now = Plan(dimension, scale, cosine, functions, width, TABLES)
        if now.slots**functions >= 1 << 62:
            break
        chances = now.chances(samples).reshape(-1, functions, now.slots)
        _, visited = now.visits(chances, now.share(), 16 * VISITS)
        if visited.sum(axis=1).mean() > VISITS:
            break
        best = now
    return best


def clean(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the number of components.

    That number is the most frequent one, of equally frequent ones the smallest. Rows with another one,
    without id, or whose vector is null, zero or holds null or non-finite components take no part.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    first = sizes.orderBy(F.desc("rows"), "n").first()
    dimension = first["n"] if first else 0
    return rows.where(F.size("vector") == dimension), dimension


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    places = column.offsets.to_numpy()
    return column.values.to_numpy()[places[0] : places[-1]].reshape(-1, dimension)


def _sample_cosine(
    rows: DataFrame, queries: DataFrame, scale: float, vectors: int, count: int, quantile: float
) -> float:
    """The cosine of the last wanted neighbour, as a sample has it: a low one of its queries'."""

    def some(df: DataFrame, number: int) -> pa.Table:
        return df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(number).toArrow().combine_chunks()

    asked, others = some(queries, SAMPLE_QUERIES), some(rows, SAMPLE_VECTORS)
    if asked.num_rows == 0 or others.num_rows < 2:
        return 0.5
    one, two = (np.array(t["vector"].to_pylist(), dtype=np.float64) for t in (asked, others))
    near = (one / np.linalg.norm(one, axis=1)[:, None]) @ (two / scale).T
    near[asked["vec_id"].to_numpy()[:, None] == others["vec_id"].to_numpy()[None, :]] = -2
    place = max(1, min(math.ceil(count * others.num_rows / vectors), others.num_rows - 1))
    return float(np.quantile(np.sort(near, axis=1)[:, -place], quantile))


def _placed(plan: Plan, asked: bool):
    """Rows (table, bucket, id) of vectors, or of the buckets that queries visit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64 if asked else 8192):
                part = batch.slice(k, 64 if asked else 8192)
                ids, vectors = part.column(0).to_numpy(), _matrix(part.column(1), plan.dimension)
                tables = np.tile(np.arange(plan.tables, dtype=np.int32), len(ids))
                ids = np.repeat(ids, plan.tables)
                if asked:
                    chances = plan.chances(vectors).reshape(len(ids), plan.functions, plan.slots)
                    code, visited = plan.visits(chances, plan.share(), 4 * VISITS)
                    times = visited.sum(axis=1)
                    tables, ids, code = np.repeat(tables, times), np.repeat(ids, times), code[visited]
                else:
                    code = plan.buckets(vectors).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tables), pa.array(code), pa.array(ids)], ["table", "bucket", "vec_id"]
                )

    return scan


def _best(scores: np.ndarray, ids: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Rows of the `count` best of each owner, ties to smaller ids; one row for each id."""
    order = np.lexsort((ids, -scores, owner))
    new = np.ones(len(order), dtype=bool)
    same = (owner[order][1:] == owner[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    new[1:] = ~same  # repeats of an id that have one score; others are settled when all blocks meet
    order = order[new]
    own = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[rank < count]


def _search(dimension: int, count: int):
    """Blocks come as their vectors (kind 0), sorted by cell, and then the queries (kind 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, members = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                if blocks[low] != block:
                    block, parts, members = int(blocks[low]), [], None
                part = batch.slice(low, high - low)
                if kinds[low] == 0:
                    cells = part.column("cells")
                    cells = cells.values.to_numpy()[cells.offsets.to_numpy()[:-1]]
                    parts.append((cells, part.column("vec_id").to_numpy(), _matrix(part.column("vector"), dimension)))
                elif parts:
                    if members is None:
                        members = _by_cell(parts)
                    for k in range(0, part.num_rows, QUERY_ROWS):
                        yield _answers(members, part.slice(k, QUERY_ROWS), dimension, count)

    return scan


def _by_cell(parts: list[tuple]) -> tuple:
    cells, ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, cells))
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.append(first, len(cells)), ids[order], vectors[order]


def _answers(members: tuple, queries: pa.RecordBatch, dimension: int, count: int) -> pa.RecordBatch:
    """The best vectors of the cells that each query visits."""
    cells, bounds, ids, vectors = members
    asked, wanted = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), dimension)
    lists = queries.column("cells")
    places = lists.offsets.to_numpy()
    visited = lists.values.to_numpy()[places[0] : places[-1]]
    owner = np.repeat(np.arange(len(asked)), np.diff(places))
    at = np.minimum(np.searchsorted(cells, visited), len(cells) - 1)
    there = cells[at] == visited
    order = np.argsort(at[there], kind="stable")
    at, owner = at[there][order], owner[there][order]
    cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else at
    rows, columns = [], []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = bounds[at[low]], bounds[at[low] + 1]
        who = owner[low:high]
        scores = wanted[who] @ vectors[x:y].T
        scores[asked[who][:, None] == ids[None, x:y]] = -np.inf
        if y - x > count:
            # Rounding may differ between products, so what is a hair below the last one stays too.
            last = np.partition(scores, y - x - count, axis=1)[:, y - x - count]
            last = last - 1e-9 * np.maximum(1, np.abs(last))
            keep = np.nonzero((scores >= last[:, None]) & (scores > -np.inf))
        else:
            keep = np.nonzero(scores > -np.inf)
        rows.append(who[keep[0]])
        columns.append(keep[1] + x)
    if not rows:
        empty = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        return pa.RecordBatch.from_arrays(empty, ["query_id", "vec_id", "score"])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    # Exact scores, the same for the same vectors wherever they are.
    exact = np.empty(len(rows))
    for k in range(0, len(rows), 1 << 16):
        part = slice(k, k + (1 << 16))
        exact[part] = (wanted[rows[part]] * vectors[columns[part]]).sum(axis=1)
    best = _best(exact, ids[columns], rows, count)
    return pa.RecordBatch.from_arrays(
        [pa.array(asked[rows[best]]), pa.array(ids[columns[best]]), pa.array(exact[best])],
        ["query_id", "vec_id", "score"],
    )


def _norm(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def _found(rows: DataFrame, queries: DataFrame, chosen: Plan, vectors: int, count: int) -> DataFrame:
    """query_id, vec_id, score: at most `count` of the vectors that each query meets in a block."""
    size = max(count, BLOCK_BYTES // (8 * chosen.dimension))
    blocks = math.ceil(vectors * chosen.tables / size)
    schema = "table int, bucket long, vec_id long"
    placed = rows.select("vec_id", "vector").mapInArrow(_placed(chosen, False), schema)
    visits = queries.select("vec_id", "vector").mapInArrow(_placed(chosen, True), schema)
    large = placed.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).alias("deals")).where("deals > 1")
    large = written(large, "large_buckets")

    def celled(df: DataFrame, deal) -> DataFrame:
        cell = F.xxhash64("table", "bucket", "deal")
        joined = df.join(large, ["table", "bucket"], "left").withColumn("deal", deal(F.coalesce("deals", F.lit(1))))
        return joined.withColumn("cell", cell).withColumn("block", F.pmod("cell", F.lit(blocks)))

    members = (
        celled(placed, lambda deals: F.pmod(F.xxhash64("vec_id"), deals))
        .select("block", "vec_id", "table", "cell")
        .groupBy("block", "vec_id")
        .agg(F.collect_list("cell").alias("cells"))  # one for each table at most
        .join(rows, "vec_id")
        .select("block", F.lit(0).alias("kind"), "vec_id", "vector", F.explode("cells").alias("cell"))
        .withColumn("cells", F.array("cell"))
        .drop("cell")
    )
    asking = (
        celled(visits, lambda deals: F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)))
        .groupBy("block", "vec_id")
        .agg(F.collect_list("cell").alias("cells"))  # the buckets of one query in a block
        .join(queries, "vec_id")
        .select("block", F.lit(1).alias("kind"), "vec_id", "vector", "cells")
    )
    return (
        members.unionByName(asking)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(_search(chosen.dimension, count), "query_id long, vec_id long, score double")
    )


def _ranked(found: DataFrame, count: int) -> DataFrame:
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, count: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each query.

    Queries are the vectors whose vec_id is divisible by `every`, candidates all but the query's own id.
    Rows that repeat a vec_id are one candidate with its best score; as a query, the smallest of their
    vectors counts. Each query gets `count` vectors, or all candidates if they are fewer.
    """
    rows, dimension = clean(embeddings)
    rows = written(rows, "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors, scale = rows.agg(F.count(F.lit(1)), F.max(_norm("vector"))).first()
    if not vectors:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale *= 1 + 1e-12
    results = []
    for quantile in QUANTILES:
        cosine = _sample_cosine(rows, queries, scale, vectors, count, quantile)
        chosen = plan(dimension, scale, cosine, vectors, count)
        if not chosen.functions:
            break
        found = written(_ranked(_found(rows, queries, chosen, vectors, count), count), "found")
        results.append(found)
        # The last wanted one is close enough, so the plan held for all that are closer, too.
        last = found.where(F.col("rank") == count).select(F.col("query_id").alias("vec_id"), "score")
        enough = F.coalesce(F.col("score") >= chosen.cosine * scale * _norm("vector"), F.lit(False))
        queries = written(queries.join(last, "vec_id", "left").where(~enough).drop("score"), "open_queries")
        if queries.isEmpty():
            break
    if not queries.isEmpty():
        every_one = plan(dimension, scale, 0.5, 0, count)  # one bucket
        results.append(_found(rows, queries, every_one, vectors, count).select("query_id", "vec_id", "score"))
    if not results:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, (r.select("query_id", "vec_id", "score") for r in results))
    return _ranked(found, count)
