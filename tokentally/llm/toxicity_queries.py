"""Query of operator 6."""

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .toxicity import classify


@query("op6_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumnRenamed("rejected", "toxic")
