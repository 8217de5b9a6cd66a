"""Running a stream to a table, with its checkpoint in the cluster's shared folder."""

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_folder
from ..sources.store import Store, newest


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What tells a stream from others: it stays while its checkpoint does."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def write_stream(
    df: DataFrame,
    target: str,
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
    keys: Sequence[str] = (),
) -> StreamingQuery:
    """Start a stream that writes Parquet to `target`; `read_result` reads it.

    Append goes to the file sink, exactly once. Complete and update go to a `Store`, where a repeated or cut
    batch changes nothing. Complete keeps the newest batch only. Update keeps all, and with `keys` merges
    them to the newest row of each key, so a read opens a bounded number of runs after any number of
    batches.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        return writer.outputMode(mode).format("parquet").option("path", target).start()
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, target, schema, newest(keys) if keys else None)
        store.add(batch, batch_id, stream_id(spark, checkpoint), replacing=mode == "complete")

    return writer.outputMode(mode).foreachBatch(write).start()


def read_result(
    spark: SparkSession, target: str, schema: T.StructType, mode: str = "append", keys: Sequence[str] = ()
) -> DataFrame:
    """What a stream has written: all rows, of `complete` the newest totals, of `update` the newest
    row of each key. Nothing written gives no rows."""
    if mode == "append":
        return spark.read.schema(schema).parquet(target)
    return Store(spark, target, schema).read(newest(keys) if mode == "update" else None)


def run_available(
    df: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = (), folder: str | None = None
) -> DataFrame:
    """Run a stream over everything available now and return the table it wrote.

    Append holds what the watermark has closed; update and complete hold all windows. Without a
    `folder` of the caller's, table and checkpoint last as long as the application.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, name)
    schema = df.schema
    query = write_stream(df, f"{folder}/table", f"{folder}/checkpoint", mode, keys=keys)
    query.awaitTermination()
    return read_result(spark, f"{folder}/table", schema, mode, keys)
