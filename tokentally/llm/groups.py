"""Small helpers for tasks that read rows sorted by a group key, and for links between nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of rows gathered before they are handed on.
SLAB_BYTES = 32 << 20


#: Spark's bound on the bytes of an Arrow batch, however large its rows are.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Spark's codec for tables it writes: snappy, unless set.
TABLE_CODEC = "spark.sql.parquet.compression.codec"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within the block, the session has these settings; what is computed in it must be written in it."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a new group starts, the first one included."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], limit: int = SLAB_BYTES
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the first row of each group and the end.

    The batches are sorted by the keys; a group larger than the limit makes a table of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _changes(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), np.append(starts[:-1], cut)
            table = table.slice(cut)
        held = table.to_batches()
        size = table.nbytes
        if not cut:
            limit = max(limit, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, np.append(_changes(table, keys), table.num_rows)


def pairs_within(bounds: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row, later row of its group), at most about `limit` pairs at once."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    rows = np.arange(len(ends)) + (bounds[0] if len(bounds) else 0)
    counts = ends - rows - 1
    upto = np.cumsum(counts)
    first = 0
    while first < len(rows):
        base = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, base + limit, "right")), first + 1)
        part = slice(first, last)
        total = int(counts[part].sum())
        if total:
            shift = np.cumsum(counts[part]) - counts[part]
            other = np.repeat(rows[part] + 1 - shift, counts[part]) + np.arange(total)
            yield np.repeat(rows[part], counts[part]), other
        first = last


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of links (a, b).

    Rounds of two steps until nothing changes: each node's larger neighbours are linked to its
    smallest neighbour, then each node's smaller neighbours are. Links never grow in number, paths
    shrink by half or more, and smallest neighbours are pre-aggregated, so a node with very many
    links does not gather them in one task. Every round is written to the shared folder.
    """
    links = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )

    def size(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    seen = size(links)
    while seen[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        links = written(small.where("a <> b").distinct(), "links")
        now = size(links)
        if now == seen:
            break
        seen = now
    ends = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.union(roots)
