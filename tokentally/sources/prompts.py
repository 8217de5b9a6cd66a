"""Prompt logs: gzip files of one JSON document each, in `<type>/<region>/yyyy/MM/dd`."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.fields import text_tokens
from ..functions.periods import Period, day_glob
from ..operators.prompts import flatten_records

LOG_TYPES = {"chat": "GenerateAssistantResponse", "inline": "GenerateCompletions"}


def _log_glob(root: str, period: Period, kind: str | None, region: str) -> str:
    types = [LOG_TYPES[kind]] if kind else list(LOG_TYPES.values())
    return f"{root.rstrip('/')}/{{{','.join(types)}}}/{region}/{day_glob(period)}"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_prompt_files(
    spark: SparkSession,
    root: str,
    period: Period,
    kind: str | None = None,
    region: str = "us-east-1",
    skip_broken: bool = False,
) -> DataFrame:
    """The `records` documents of a period, of one kind or both, with their `file`.

    Only the day directories of the period are listed. No directory at all gives no rows. A broken
    file stops the query, as does a failing store. With `skip_broken`, files that are not gzip or not
    JSON are left out; `file_counts` tells how many.
    """
    reader = (
        spark.read.schema(schemas.PROMPT_LOG)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json.gz")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", skip_broken)
        .option("mode", "DROPMALFORMED" if skip_broken else "FAILFAST")
    )
    try:
        logs = reader.json(_log_glob(root, period, kind, region))
    except AnalysisException as error:
        if not _missing(error):
            raise
        empty = spark.createDataFrame([], schemas.PROMPT_LOG)
        return empty.select("records", F.lit(None).cast("string").alias("file"))
    return logs.select("records", F.col("_metadata.file_path").alias("file"))


def file_counts(
    spark: SparkSession, root: str, period: Period, kind: str | None = None, region: str = "us-east-1"
) -> DataFrame:
    """One row: files listed, files that gave a document, and files skipped as broken.

    The listing opens no file; the documents are parsed without their records.
    """
    read = read_prompt_files(spark, root, period, kind, region, skip_broken=True)
    given = read.where(F.col("records").isNotNull()).select("file").distinct()
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz")
    try:
        files = reader.option("recursiveFileLookup", True).load(_log_glob(root, period, kind, region))
    except AnalysisException as error:
        if not _missing(error):
            raise
        files = spark.createDataFrame([], "path string")
    listed, found = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((files, "files"), (given, "read")))
    return listed.select("files", found.scalar().alias("files_read")).withColumn(
        "files_skipped", F.col("files") - F.col("files_read")
    )


def read_prompts(
    spark: SparkSession,
    root: str,
    period: Period,
    kind: str | None = None,
    region: str = "us-east-1",
    count_tokens=text_tokens,
    skip_broken: bool = False,
) -> DataFrame:
    """Flat prompt rows with token counts of a period; reads every file."""
    logs = read_prompt_files(spark, root, period, kind, region, skip_broken)
    return flatten_records(logs, count_tokens)
