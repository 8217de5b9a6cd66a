"""Query of operator 9: documents labelled as good are the target."""

from pyspark.sql import DataFrame, SparkSession

from .language_models import score_documents
from .registry import query, table


@query("op9_language_models")
def language_models(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return score_documents(table(spark, folder, "documents"), good)
