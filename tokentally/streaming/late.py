"""Windows that late records correct.

A stream in append mode gives a window out once it is closed, and Spark drops what comes later. Here late
records are kept: they are counted by window in a side table, and closed windows can be read with or without
them. Sums of windows are added up batch by batch in a `Store`, so the stream itself holds no state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import short_lived_tables, written
from ..sources.store import Store, summed
from .jobs import stream_id
from .trends import ARCHIVE_DELAY, usage_trend

_TYPES = {
    "window_start": T.TimestampType(), "window_end": T.TimestampType(), "application_name": T.StringType(),
    "total_tokens": T.LongType(), "requests": T.LongType(), "late": T.BooleanType(),
}
_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _TYPES.items()])
_SUMS = ("total_tokens", "requests")
_KEYS = tuple(name for name in _SCHEMA.names if name not in _SUMS)
_WATERMARK = "watermark"


def _store(spark: SparkSession, target: str) -> Store:
    return Store(spark, target, _SCHEMA, summed(_KEYS, _SUMS))


def write_windows(
    timed: DataFrame,
    target: str,
    checkpoint: str,
    delay: str = ARCHIVE_DELAY,
    every: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream that adds the usage of records with `event_time` to the windows at `target`.

    The watermark is the newest event time of earlier batches less the delay, and never falls. A record is
    late if its window had ended by then. Records without an event time are in no window. A repeated or cut
    batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _store(spark, target)
        old = store.manifest().facts.get(_WATERMARK)
        late = F.lit(False) if old is None else F.col("window_end") <= F.timestamp_millis(F.lit(old))
        with short_lived_tables(spark):
            # Written, so that the batch is read once for its sums and its newest time.
            sums = written(usage_trend(batch, every, newest=F.max("event_time")).withColumn("late", late), "sums")
            mark = sums.agg(F.unix_millis(F.max("newest") - F.expr(f"INTERVAL {delay}"))).first()[0]
            known = [m for m in (old, mark) if m is not None]
            facts = {_WATERMARK: max(known, default=None)}
            store.add(sums.select(*_SCHEMA.names), batch_id, stream_id(spark, checkpoint), facts=facts)

    writer = timed.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.outputMode("append").foreachBatch(write).start()


@dataclass(frozen=True)
class Windows:
    """What `write_windows` has written, as of now. `watermark` is in milliseconds; None before any record."""

    rows: DataFrame
    watermark: int | None

    def _sums(self, rows: DataFrame) -> DataFrame:
        keys = [k for k in _KEYS if k != "late"]
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))

    def _closed(self) -> DataFrame:
        mark = F.lit(None) if self.watermark is None else F.lit(self.watermark)
        return self.rows.where(F.col("window_end") <= F.timestamp_millis(mark.cast("long")))

    def closed(self) -> DataFrame:
        """Closed windows as append mode gives them out: without late records."""
        return self._sums(self._closed().where(~F.col("late")))

    def late(self) -> DataFrame:
        """The side table: what late records add to their windows, and how many they are."""
        return self._sums(self.rows.where("late"))

    def corrected(self) -> DataFrame:
        """Closed windows with their late records."""
        return self._sums(self._closed())

    def all(self) -> DataFrame:
        """All windows so far, open ones included, with late records."""
        return self._sums(self.rows)


def read_windows(spark: SparkSession, target: str) -> Windows:
    store = _store(spark, target)
    return Windows(store.read(), store.manifest().facts.get(_WATERMARK))
