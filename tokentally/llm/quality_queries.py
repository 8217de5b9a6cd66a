"""Query of operator 13."""

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import STOP_WORDS, judged
from .registry import query, table

_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)

SQL = (
    r"""
WITH split AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT k, i, array_to_string(words[i : i + 7], ' ') AS w FROM split, unnest(range(1, len(words) - 6)) AS t(i)),
again AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
steps AS (
  SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS step FROM again),
repeated AS (SELECT k, sum(step)::BIGINT AS n FROM steps GROUP BY k),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(body, '[^!?]', '', 'g')) AS n_marks,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
         len(list_filter(words, lambda x: lower(x) IN (STOP))) AS n_stop_words,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (k)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         concat_ws(',',
           CASE WHEN n_words > 0 AND (100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words) THEN 'word_length' END,
           CASE WHEN n_words > 0 AND 100 * n_symbols > 10 * n_words THEN 'symbols' END,
           CASE WHEN n_words > 0 AND 100 * n_marks > 50 * n_words THEN 'marks' END,
           CASE WHEN n_words > 0 AND 100 * n_letter_words < 80 * n_words THEN 'letters' END,
           CASE WHEN n_words > 0 AND 100 * n_stop_words < 2 * n_words THEN 'stop_words' END,
           CASE WHEN n_lines > 0 AND 100 * n_bullet_lines > 90 * n_lines THEN 'bullet_lines' END,
           CASE WHEN n_lines > 0 AND 100 * n_cut_lines > 30 * n_lines THEN 'cut_lines' END,
           CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines THEN 'repeated_lines' END) AS broken
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken
FROM judged
"""
).replace("STOP", _STOP)


@query("op13_quality_rules", SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"))
