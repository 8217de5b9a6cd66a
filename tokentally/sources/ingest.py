"""Reading an archive bit by bit: each run takes the files that no run before has read, of any age.

A table of files (path, size, time) says what was read. A run lists the day directories month by month,
leaves out what the table holds, and takes the rest in batches of a bounded number of files. So the
driver never holds more than the listing of a month, and a batch's paths, however large the archive is.

A batch's files are noted first and its rows added then, each in a `Store`. If a run ends between the two,
the next one starts with the files noted: every file is read once, whatever happens.
"""

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.periods import Period, day_glob
from .invocations import DAY_KEYS, with_day_keys
from .shared import written
from .store import BATCH, Store, newest

FILES = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType())]
)
_FILE = "_file"
#: A fact of the table: whether some file was read again, as it had changed.
_CHANGED = "changed"

#: Records of some files, from the session, their paths and the schema.
Reader = Callable[[SparkSession, list[str], T.StructType], DataFrame]


def strict(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Line-JSON records; a broken one stops the run, before anything of its batch counts."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def months(period: Period) -> Iterator[Period]:
    """The period in pieces of at most a calendar month."""
    first = period.start
    while first <= period.end:
        after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
        yield Period(first, min(after - timedelta(days=1), period.end))
        first = after


def listed(spark: SparkSession, root: str, period: Period) -> DataFrame:
    """file, size, modified of the files in the period's day directories; none is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = reader.load(f"{root.rstrip('/')}/{day_glob(period)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    return found.select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


class Archive:
    """A table at `target` of the records under `root` that were read so far."""

    def __init__(
        self, spark: SparkSession, root: str, target: str, schema: T.StructType = schemas.INVOCATION, read: Reader = strict
    ):
        self.spark, self.root, self.schema, self.read_files = spark, root, schema, read
        keys = [T.StructField(key, T.StringType()) for key in DAY_KEYS]
        own = T.StructType([*schema.fields, *keys, T.StructField(_FILE, T.StringType())])
        self._rows = Store(spark, f"{target.rstrip('/')}/rows", own)
        self._files = Store(spark, f"{target.rstrip('/')}/files", FILES, newest(["file"]))

    def _noted(self) -> DataFrame:
        """The newest state of each file that was noted, with its batch."""
        return self._files.merge(self._files._rows(self._files.manifest().runs))

    def files(self) -> DataFrame:
        """file, size, modified of all files read."""
        return self._noted().where(F.col(BATCH) <= self._rows.manifest().through).drop(BATCH)

    def new_files(self, period: Period) -> DataFrame:
        """The files of a period that were not read in their present size and time."""
        here = listed(self.spark, self.root, period)
        return here.join(self._noted().drop(BATCH), ["file", "size", "modified"], "left_anti")

    def _read_noted(self) -> int:
        """Read the files of the batch that was noted last, if that was not done; returns their number."""
        batch = self._files.manifest().through
        if self._rows.manifest().through >= batch:
            return 0
        noted = self._noted().where(F.col(BATCH) == batch).select("file").collect()  # files_per_batch
        paths = [row["file"] for row in noted]
        records = self.read_files(self.spark, paths, self.schema).select("*", F.col("_metadata.file_path").alias(_FILE))
        records = with_day_keys(records, F.col(_FILE)).select(*(f"`{n}`" for n in self._rows.schema.names if n != BATCH))
        self._rows.add(records, batch)
        return len(paths)

    def _note(self, some: list) -> None:
        frame = self.spark.createDataFrame(some, FILES)
        old = self._files.manifest()
        again = old.facts.get(_CHANGED) or not frame.join(self._noted(), "file", "left_semi").isEmpty()
        self._files.add(frame, old.through + 1, facts={_CHANGED: bool(again)})

    def ingest(self, period: Period, files_per_batch: int = 1000) -> int:
        """Read all files of a period that are new or have changed; returns how many were read."""
        count = self._read_noted()
        for month in months(period):
            fresh = written(self.new_files(month), "new_files")
            some: list = []
            for row in fresh.orderBy("file").toLocalIterator():
                some.append(row)
                if len(some) == files_per_batch:
                    self._note(some)
                    count += self._read_noted()
                    some = []
            if some:
                self._note(some)
                count += self._read_noted()
        return count

    def read(self) -> DataFrame:
        """All records read, with `year`, `month`, `day`. Of a file that had changed, those of its last state."""
        rows = self._rows._rows(self._rows.manifest().runs)
        if self._files.manifest().facts.get(_CHANGED):
            # By file, the last batch that has added rows of it; a few rows a file, not a window over rows.
            last = rows.groupBy(_FILE).agg(F.max(BATCH).alias(BATCH))
            rows = rows.join(last, [_FILE, BATCH], "left_semi")
        return rows.drop(BATCH, _FILE)
