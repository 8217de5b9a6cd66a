"""Query of operator 2."""

from pyspark.sql import DataFrame, SparkSession

from .license_scan import scan_licenses
from .registry import query, table


@query("op2_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))
