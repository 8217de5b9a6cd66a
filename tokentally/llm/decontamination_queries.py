"""Query of operator 7."""

from pyspark.sql import DataFrame, SparkSession

from .decontamination import matches
from .registry import query, table


@query("op7_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tie")
