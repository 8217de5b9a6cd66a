"""Daily activity reports: CSV files with 46 columns in fixed order."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import ACTIVITY_COUNTERS


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity rows under `path`; an empty or broken counter is NULL.

    Columns are taken by position; the header line is skipped, whatever it says.
    """
    text = (
        spark.read.schema(schemas.ACTIVITY_TEXT)
        .option("header", True)
        .option("quote", '"')
        .option("escape", "\\")
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    counters = [F.col(name).try_cast("int").alias(name) for name in ACTIVITY_COUNTERS]
    return text.select("UserId", "Date", *counters)
