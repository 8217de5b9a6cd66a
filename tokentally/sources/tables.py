"""Checks on tables and files, and removal of a table."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import on_day


def row_count(df: DataFrame, day: date | None = None) -> DataFrame:
    """One row with the number of records, of one day if given."""
    rows = on_day(df, day) if day else df
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:table)", args={"table": table})
