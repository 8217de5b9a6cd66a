"""Reading that goes on where a record or a file is broken, and keeps what is broken beside the rest.

The strict readers stay the default: they stop at the first broken record. Here the input is parsed once,
written, and split into good and broken records.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.periods import Period, day_glob
from .invocations import DAY_KEYS, events_of, with_day_keys
from .shared import written

_BROKEN = "_broken"
#: Bytes of a compressed file that are unpacked at once.
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Sorted:
    """records: the good ones, as the strict reader gives them. broken: file, record (its text). files:
    file, good, broken (records), state: "whole", or for a compressed file "cut" or "no gzip"; files
    without a byte are not listed."""

    records: DataFrame
    broken: DataFrame
    files: DataFrame


def _state(content: bytes) -> str:
    """Whether gzip data, of one or several members, is whole. Unpacked bit by bit and thrown away."""
    unpack, begun = zlib.decompressobj(31), False
    try:
        rest = content
        while rest:
            unpack.decompress(rest, _CHUNK)
            rest = unpack.unconsumed_tail
            if unpack.eof:
                rest = unpack.unused_data.lstrip(b"\0")
                unpack = zlib.decompressobj(31) if rest else unpack
            elif not rest:
                # All is taken in; what is still inside comes out now.
                while unpack.decompress(b"", _CHUNK):
                    pass
            begun = True
    except zlib.error:
        return "cut" if begun else "no gzip"
    return "whole" if unpack.eof else "cut"


def gzip_states(spark: SparkSession, path: str) -> DataFrame:
    """file, state of the compressed files under a path. A file is one row, so it is read by one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [_state(content.as_buffer()) for content in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.string())], ["file", "state"])

    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "content").mapInArrow(scan, "file string, state string")


def _sorted(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, name: str) -> Sorted | None:
    """Parsed once; None if there is no such path. A file that ends early gives the records before."""
    reader = (
        spark.read.schema(schema.add(_BROKEN, T.StringType()) if _BROKEN not in schema.names else schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("ignoreCorruptFiles", True)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
    )
    try:
        parsed = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    parsed = written(parsed.select("*", F.col("_metadata.file_path").alias("file")), name)
    is_broken = F.col(_BROKEN).isNotNull()
    counts = parsed.groupBy("file").agg(
        F.count_if(~is_broken).alias("good"), F.count_if(is_broken).alias("broken")
    )
    states = written(gzip_states(spark, path), "gzip_states")
    files = counts.join(states, "file", "full").select(
        "file",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "broken")),
        F.coalesce("state", F.lit("whole")).alias("state"),
    )
    broken = parsed.where(is_broken).select("file", F.col(_BROKEN).alias("record"))
    return Sorted(parsed.where(~is_broken).drop(_BROKEN), broken, files)


def sort_invocations(
    spark: SparkSession, root: str, period: Period | None = None, schema: T.StructType = schemas.INVOCATION
) -> Sorted:
    """`read_invocations` that sets broken records aside.

    Broken is a line that is no JSON, or whose fields do not have the schema's types. Of a cut file all
    records before the cut are read. Files outside day directories count neither way. A period without
    any directory has nothing.
    """
    path = f"{root.rstrip('/')}/{day_glob(period)}" if period else root
    found = _sorted(spark, path, T.StructType(schema.fields), False, "invocations")
    if found is None:
        keys = [T.StructField(key, T.StringType()) for key in DAY_KEYS]
        return Sorted(
            spark.createDataFrame([], T.StructType([*schema.fields, *keys])),
            spark.createDataFrame([], "file string, record string"),
            spark.createDataFrame([], "file string, good long, broken long, state string"),
        )
    columns = [f"`{name}`" for name in schema.names]
    return Sorted(
        with_day_keys(found.records, F.col("file")).select(*columns, *DAY_KEYS),
        with_day_keys(found.broken, F.col("file")).drop(*DAY_KEYS),
        with_day_keys(found.files, F.col("file")).drop(*DAY_KEYS),
    )


def sort_tagged_invocations(spark: SparkSession, root: str, period: Period | None = None) -> Sorted:
    """The same with request id, operation and the metadata map."""
    return sort_invocations(spark, root, period, schemas.TAGGED_INVOCATION)


def sort_log_events(spark: SparkSession, path: str) -> Sorted:
    """`read_log_events` that sets broken documents aside. A file is one document, so it counts as a whole."""
    found = _sorted(spark, path, T.StructType(schemas.LOG_EVENTS.fields), True, "log_events")
    if found is None:
        raise FileNotFoundError(path)
    return Sorted(events_of(found.records), found.broken, found.files)
