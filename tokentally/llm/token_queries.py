"""Query of operator 1."""

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .token_files import tokens_through_files


@query("op1_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokens_through_files(table(spark, folder, "documents"))
