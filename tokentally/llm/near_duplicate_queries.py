"""Query of operator 5."""

from pyspark.sql import DataFrame, SparkSession

from .near_duplicates import near_duplicates
from .registry import query, table


@query("op5_near_duplicates")
def near_duplicate_documents(spark: SparkSession, folder: str) -> DataFrame:
    marked = near_duplicates(table(spark, folder, "documents"))
    return marked.select("doc_id", "n_shingles", "component_id", "kept")
