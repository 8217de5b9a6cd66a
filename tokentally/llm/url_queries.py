"""Query of operator 3."""

from pyspark.sql import DataFrame, SparkSession

from .filter_cascade import judge, rule_table
from .registry import query, table

SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, '.' || host AS dotted FROM parsed),
chosen AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM chosen
"""


@query("op3_url_filter", SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), rule_table(spark))
