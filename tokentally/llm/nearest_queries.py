"""Query of operator 4."""

from pyspark.sql import DataFrame, SparkSession

from .nearest import nearest
from .registry import query, table


@query("op4_nearest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
