"""Invocation logs: JSON files in `yyyy/MM/dd` directories, and tables over them."""

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.periods import Period, day_glob

DAY_KEYS = ("year", "month", "day")
#: A file source skips files this much older than the newest one it has seen; a week if not set.
ANY_AGE = "36500d"


def with_day_keys(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Add the partition keys, as text, from the directory of each row's file.

    Files outside day directories hold no calls of any day and are left out.
    """
    path = F.col("_metadata.file_path") if path is None else path
    keys = [
        F.regexp_extract(path, r"/(\d{4})/(\d{2})/(\d{2})/", i + 1).alias(key)
        for i, key in enumerate(DAY_KEYS)
    ]
    return df.select("*", *keys).where(F.col("year") != "")


def read_invocations(
    spark: SparkSession,
    root: str,
    period: Period | None = None,
    schema: T.StructType = schemas.INVOCATION,
) -> DataFrame:
    """Line-JSON records under `root`, with `year`, `month`, `day` from the path.

    A period limits the listing to its day directories: other days are neither listed nor read.
    The day directories may hold sub-directories. A period without any directory has no calls. A
    broken record stops the query.
    """
    path = f"{root.rstrip('/')}/{day_glob(period)}" if period else root
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    try:
        return with_day_keys(reader.json(path))
    except AnalysisException as error:
        if not period or error.getCondition() != "PATH_NOT_FOUND":
            raise
        keys = [T.StructField(key, T.StringType()) for key in DAY_KEYS]
        return spark.createDataFrame([], T.StructType([*schema.fields, *keys]))


def stream_invocations(
    spark: SparkSession,
    root: str,
    schema: T.StructType = schemas.TAGGED_INVOCATION,
    files_per_batch: int = 1000,
) -> DataFrame:
    """The records of day directories as a stream, new files in bounded batches.

    The file count bounds the work of a batch, also of the first one over a long archive. No file is
    too old to be read, so a restored copy or a late upload counts.
    """
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    reader = reader.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", ANY_AGE)
    return with_day_keys(reader.option("recursiveFileLookup", True).json(root))


def read_tagged_invocations(
    spark: SparkSession, root: str, period: Period | None = None
) -> DataFrame:
    """Like `read_invocations`, with request id, operation and the metadata map."""
    return read_invocations(spark, root, period, schemas.TAGGED_INVOCATION)


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    """Exported log events: tagged records with event and ingestion time, latency and usage.

    Each file is one document, so a file is one task. A broken file stops the query.
    """
    reader = spark.read.schema(schemas.LOG_EVENTS).option("multiLine", True).option("mode", "FAILFAST")
    return events_of(reader.json(path))


def events_of(documents: DataFrame) -> DataFrame:
    """The events of log-event documents, a row each."""
    event = documents.select(F.explode("events").alias("e"))
    body = F.col("e.message.output.outputBodyJson")
    return event.select(
        "e.message.*",
        F.timestamp_millis("e.timestamp").alias("event_time"),
        F.timestamp_millis("e.ingestionTime").alias("ingestion_time"),
        body["metrics"]["latencyMs"].alias("latency_ms"),
        body["stopReason"].alias("stop_reason"),
        body["usage"]["totalTokens"].alias("total_tokens"),
    )


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)


def create_table(
    spark: SparkSession, table: str, root: str, schema: T.StructType = schemas.INVOCATION
) -> None:
    """Create a catalogue table over JSON day directories, with no day attached yet.

    As in `read_invocations`, a broken record stops a query.
    """
    keys = ", ".join(f"`{key}` string" for key in DAY_KEYS)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:table) ({_columns(schema)}, {keys}) USING json "
        f"OPTIONS (mode 'FAILFAST') PARTITIONED BY ({', '.join(DAY_KEYS)}) LOCATION '{_quoted(root)}'",
        args={"table": table},
    )


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _partition(day: date) -> str:
    return f"PARTITION (year='{day:%Y}', month='{day:%m}', day='{day:%d}')"


def attach_day(spark: SparkSession, table: str, root: str, day: date) -> None:
    """Attach the directory of one day to the table; no change if it is attached already."""
    location = _quoted(f"{root.rstrip('/')}/{day:%Y/%m/%d}/")
    spark.sql(
        f"ALTER TABLE IDENTIFIER(:table) ADD IF NOT EXISTS {_partition(day)} "
        f"LOCATION '{location}'",
        args={"table": table},
    )


def repair_day(spark: SparkSession, table: str, root: str, day: date) -> None:
    """Attach one day anew, for instance after its location has changed. No file is deleted."""
    spark.sql(
        f"ALTER TABLE IDENTIFIER(:table) DROP IF EXISTS {_partition(day)}", args={"table": table}
    )
    attach_day(spark, table, root, day)


def compact(df: DataFrame, target: str) -> None:
    """Rewrite records as Parquet by day: from many small gzip files to few columnar ones.

    The days at hand are replaced as a whole and others stay, so a job may run again.

    The rebalance hint gathers each day's rows into files of even size and splits a day that is
    much larger than others over several tasks.
    """
    rebalanced = df.hint("rebalance", *DAY_KEYS)
    writer = rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*DAY_KEYS).parquet(target)


def _interleaved(first: Column, second: Column, bits: int = 16) -> Column:
    """The lowest bits of two numbers in turns: rows near each other in it are near in both."""
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for number, place in ((first, 2 * bit + 1), (second, 2 * bit)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(number.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), place))
    return key


def compact_clustered(df: DataFrame, target: str, row_group_bytes: int = 32 << 20) -> None:
    """`compact` for later look-ups of an identity, a time or a request.

    Within a day, rows lie along an interleaved key of identity (by hash) and time, so a row group holds
    few identities and a short time. Bloom filters of each row group tell which identities and requests
    it may hold, and its statistics which times; a filter on these skips the others unread.
    """
    of_day = F.pmod(F.unix_timestamp(F.to_timestamp("timestamp")), F.lit(86_400))
    time = F.floor(F.coalesce(of_day, F.lit(0)) * 65_536 / 86_400)
    identity = F.shiftrightunsigned(F.xxhash64("identity.arn"), 48)
    keyed = df.withColumn("_key", _interleaved(identity, time))
    ordered = keyed.repartitionByRange(*DAY_KEYS, "_key").sortWithinPartitions(*DAY_KEYS, "_key").drop("_key")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.adaptive.enabled", True)
    for column in ("identity.arn", "requestId"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    writer.partitionBy(*DAY_KEYS).parquet(target)


def read_compacted(
    spark: SparkSession, path: str, schema: T.StructType = schemas.INVOCATION
) -> DataFrame:
    """Compacted records. The keys are declared as text; inference would make them numbers."""
    keys = [T.StructField(key, T.StringType()) for key in DAY_KEYS]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(path)
