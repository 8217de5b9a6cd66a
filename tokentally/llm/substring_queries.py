"""Query of operator 10."""

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table
from .substrings import without_repeats


@query("op10_substrings")
def substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")
