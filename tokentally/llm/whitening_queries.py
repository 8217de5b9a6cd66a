"""Query of operator 11."""

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .whitening import component_table


@query("op11_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    return component_table(table(spark, folder, "embeddings"))
