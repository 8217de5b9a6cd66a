"""Query of operator 8."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_table
from .registry import query, table

SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS spread
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sums),
ranked AS (
  SELECT cap, weight, cap / weight AS ratio,
         (SELECT sum(source_size) FROM sums) * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY cap / weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed),
level AS (
  SELECT ((total - held) / left_weight)::DOUBLE AS level FROM ranked
  WHERE ratio >= (total - held) / left_weight ORDER BY ratio, cap LIMIT 1),
targets AS (
  SELECT source, source_size, n_docs,
         CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, level * weight) END::DOUBLE AS target
  FROM weighed CROSS JOIN level),
strata AS (
  SELECT doc_id, size, s.source, source_size, target,
         concat_ws('|', coalesce(s.source, ''), length(bin(size)),
                   spread % greatest(1, ceil(n_docs / 100000.0))::BIGINT) AS stratum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
draws AS (
  SELECT *, ('0x' || substr(md5(stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE
            + row_number() OVER (PARTITION BY source, stratum ORDER BY size, doc_id) * 0.6180339887498949::DOUBLE AS step,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate
  FROM strata)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN step - floor(step) < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM draws
"""


@query("op8_mixing", SQL)
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_table(table(spark, folder, "documents"))
