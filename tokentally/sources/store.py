"""A table in a folder that grows by batches and is read through a manifest.

Each batch is a run: a folder of Parquet files. The manifest names the runs in force and is switched as a
whole, so a batch counts entirely or not at all: what a cut batch has left is not named, and a repeated
one is known by its number. Runs are merged in tiers: `FAN` runs of a level become one of the next, so a
row is rewritten once a level, and n batches are never more than about FAN * log(n) / log(FAN) runs.

One writer at a time: a stream, or a job that runs again and again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "_batch"
#: Runs of a level that are merged into one of the next.
FAN = 8
#: Manifests that stay; readers of the one before the newest still find its runs.
KEPT = 2

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    folder: str
    level: int
    first: int
    last: int


@dataclass(frozen=True)
class Manifest:
    """Runs in the order of their batches, the newest batch, who writes, and facts of the writer's own."""

    version: int = 0
    through: int = -1
    writer: str = ""
    runs: tuple[Run, ...] = ()
    facts: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parsed(cls, text: str) -> Manifest:
        fields = json.loads(text)
        return cls(**fields | {"runs": tuple(Run(**run) for run in fields["runs"])})


def due(runs: Sequence[Run], fan: int = FAN) -> list[Run]:
    """The runs to merge next: those of the lowest level that has `fan` of them; none if no level has."""
    for level in sorted({run.level for run in runs}):
        same = [run for run in runs if run.level == level]
        if len(same) >= fan:
            return same
    return []


def newest(keys: Sequence[str]) -> Merge:
    """Keeps the newest row of each key; null keys are keys."""

    def merge(rows: DataFrame) -> DataFrame:
        row = F.max_by(F.struct(*rows.columns), BATCH)
        return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(row.alias("row")).select("row.*")

    return merge


def summed(keys: Sequence[str], sums: Sequence[str]) -> Merge:
    """Adds rows of the same key up; null keys are keys."""

    def merge(rows: DataFrame) -> DataFrame:
        totals = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums]
        return rows.groupBy(*keys).agg(*totals, F.max(BATCH).alias(BATCH)).select(*rows.columns)

    return merge


class Store:
    """A table of rows with this schema in a folder. Without `merge` runs stay as they are."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, merge: Merge | None = None, fan: int = FAN):
        self.spark, self.folder, self.merge, self.fan = spark, folder.rstrip("/"), merge, fan
        # Any row may be null in files; only names and types count.
        fields = [T.StructField(f.name, f.dataType) for f in schema]
        self.schema = T.StructType([*fields, T.StructField(BATCH, T.LongType())])
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/_manifest") if n.endswith(".json"))

    def _load(self, version: int) -> Manifest:
        stream = self._files.open(self._path(f"{self.folder}/_manifest/{version:010d}.json"))
        try:
            return Manifest.parsed(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The newest one; an empty one if nothing was ever written."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest()

    def _switch(self, new: Manifest) -> None:
        """Written beside and renamed: readers see the old manifest or the new one."""
        aim = self._path(f"{self.folder}/_manifest/{new.version:010d}.json")
        draft = self._path(f"{self.folder}/_manifest/.{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(new.text().encode())
        stream.close()
        if self._files.exists(aim) or not self._files.rename(draft, aim):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer has changed {self.folder}")

    def _clean(self, kept: int) -> None:
        """Remove old manifests, and runs that no remaining manifest names: merged, replaced or cut ones."""
        versions = self._versions()
        named = {run.folder for v in versions[-kept:] for run in self._load(v).runs}
        for version in versions[:-kept]:
            self._files.delete(self._path(f"{self.folder}/_manifest/{version:010d}.json"), False)
        for name in self._names(self.folder):
            if name.startswith("batch=") and name not in named:
                self._files.delete(self._path(f"{self.folder}/{name}"), True)

    def _rows(self, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        # Only the runs' own folders are listed; `basePath` would make a column of their names.
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", True)
        return reader.parquet(*(f"{self.folder}/{run.folder}" for run in runs))

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> Run:
        run = Run(f"batch={last}-{uuid.uuid4().hex[:12]}", level, first, last)
        rows.write.parquet(f"{self.folder}/{run.folder}")
        return run

    def add(
        self, rows: DataFrame, batch: int, writer: str = "", replacing: bool = False, facts: dict | None = None
    ) -> bool:
        """Add a batch; False if it is there already. With `replacing` it is all there is.

        Batch numbers rise. A table goes on with the writer that began it.
        """
        old = self.manifest()
        if old.version and old.writer != writer:
            raise ValueError(f"{self.folder} belongs to another writer")
        if batch <= old.through:
            return False
        run = self._write(rows.withColumn(BATCH, F.lit(batch).cast("long")), 0, batch, batch)
        runs = [run] if replacing else [*old.runs, run]
        self._switch(Manifest(old.version + 1, batch, writer, tuple(runs), old.facts | (facts or {})))
        if self.merge and not replacing:
            self._merge_due()
        self._clean(1 if replacing else KEPT)
        return True

    def _merge_due(self) -> None:
        while some := due((now := self.manifest()).runs, self.fan):
            whole = self._write(self.merge(self._rows(some)), some[0].level + 1, some[0].first, some[-1].last)
            runs = sorted({*now.runs} - {*some} | {whole}, key=lambda run: run.first)
            self._switch(replace(now, version=now.version + 1, runs=tuple(runs)))

    def read(self, merge: Merge | None = None) -> DataFrame:
        """The rows in force, merged; of a table that was never written none."""
        rows, merge = self._rows(self.manifest().runs), merge or self.merge
        return (merge(rows) if merge else rows).drop(BATCH)
