"""Queries over prompt logs."""

from pyspark.sql import functions as F

from ..functions.fields import text_tokens
from ..operators import estimates, filters, prompts
from . import views
from .activity_queries import COST_COLUMNS, cost_sql
from .registry import query, rounded

DAYS = 30

_V = "WITH" + views.SQL_PROMPTS
_SUMS = (
    "COUNT(*) AS requests, CAST(COALESCE(SUM(input_tokens), 0) AS BIGINT) AS input_tokens, "
    "CAST(COALESCE(SUM(output_tokens), 0) AS BIGINT) AS output_tokens"
)
_TOTAL = "CAST(COALESCE(SUM(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens"
_ROWS = (
    'type, input_tokens, output_tokens, "timestamp", user_id, conversation_id, file_name'
)


@query("src_05_prompt_records", "WITH" + views.SQL_PROMPT_LOGS + f" SELECT {_ROWS} FROM v5")
def _(spark, folder):
    return prompts.flatten_records(views.prompt_logs(spark, folder))


@query("set_02_both_kinds", _V + f" SELECT {_ROWS} FROM v4")
def _(spark, folder):
    return prompts.both_kinds(
        views.chat_prompts(spark, folder), views.inline_prompts(spark, folder)
    )


@query(
    "joi_06_request_with_response",
    """SELECT conv_id, turn, CAST(length(text) // 3 AS BIGINT) AS input_tokens,
    CAST(CASE WHEN next_role = 'assistant' THEN length(next_text) // 3 END AS BIGINT) AS output_tokens
    FROM (SELECT *, LEAD(role) OVER w AS next_role, LEAD(text) OVER w AS next_text FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
)
def _(spark, folder):
    pairs = views.turns(spark, folder, text_tokens(F.col("text")))
    return pairs.select(
        "conv_id",
        "turn",
        F.col("asked").alias("input_tokens"),
        F.col("answered").alias("output_tokens"),
    )


@query(
    "flt_05_prompt_user",
    _V + f""" SELECT {_ROWS} FROM v4 WHERE lower(user_id) LIKE '%user-1%' OR user_id IS NULL
    OR user_id = ''""",
)
def _(spark, folder):
    rows = filters.by_prompt_user(views.prompts(spark, folder), "USER-1")
    return rows.select(*prompts.COLUMNS)


@query("flt_06_inline_only", _V + f" SELECT {_ROWS} FROM v4 WHERE type = 'inline'")
def _(spark, folder):
    rows = filters.by_type(views.prompts(spark, folder), "inline")
    return rows.select(*prompts.COLUMNS)


@query(
    "udf_02_token_estimate",
    """SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS tokens FROM documents""",
)
def _(spark, folder):
    documents = views.table(spark, folder, "documents")
    return documents.select("doc_id", text_tokens(F.col("text")).alias("tokens"))


@query(
    "agg_20_prompt_breakdowns",
    _V + f""", k AS (SELECT type, user_id,
      CASE WHEN "timestamp" <> '' THEN split_part("timestamp", 'T', 1) END AS date,
      CASE WHEN contains("timestamp", 'T') THEN split_part(split_part("timestamp", 'T', 2), ':', 1) END AS hour,
      input_tokens, output_tokens FROM v4)
    SELECT 'total' AS breakdown, NULL AS type, NULL AS user_id, NULL AS date, NULL AS hour, {_SUMS} FROM k
    UNION ALL SELECT 'type', type, NULL, NULL, NULL, {_SUMS} FROM k GROUP BY type
    UNION ALL SELECT 'user', NULL, user_id, NULL, NULL, {_SUMS} FROM k GROUP BY user_id
    UNION ALL SELECT 'date', NULL, NULL, date, NULL, {_SUMS} FROM k WHERE date IS NOT NULL GROUP BY date
    UNION ALL SELECT 'hour', NULL, NULL, NULL, hour, COUNT(*), NULL, NULL FROM k
      WHERE hour IS NOT NULL GROUP BY hour""",
)
def _(spark, folder):
    return prompts.breakdowns(views.prompts(spark, folder))


@query(
    "agg_20_prompts_by_date",
    _V + f""", k AS (SELECT *, split_part("timestamp", 'T', 1) AS date FROM v4 WHERE "timestamp" <> '')
    SELECT date, {_SUMS}, {_TOTAL} FROM k GROUP BY date""",
)
def _(spark, folder):
    return prompts.by_date(views.prompts(spark, folder))


@query("agg_20_prompt_totals", _V + f" SELECT {_SUMS}, {_TOTAL} FROM v4")
def _(spark, folder):
    return prompts.totals(views.prompts(spark, folder))


@query(
    "prj_08_hours_in_kst",
    _V + """, h AS (SELECT CAST(split_part(split_part("timestamp", 'T', 2), ':', 1) AS INTEGER) AS h
      FROM v4 WHERE contains("timestamp", 'T'))
    SELECT printf('%02d:00', h) AS utc_hour, printf('%02d:00', (h + 9) % 24) AS kst_hour,
    COUNT(*) AS requests FROM h GROUP BY h""",
)
def _(spark, folder):
    return prompts.hours_in_kst(views.prompts(spark, folder))


@query(
    "ord_07_peak_hour",
    _V + """, h AS (SELECT CAST(split_part(split_part("timestamp", 'T', 2), ':', 1) AS INTEGER) AS h
      FROM v4 WHERE contains("timestamp", 'T'))
    SELECT printf('%02d:00', h) AS utc_hour, printf('%02d:00', (h + 9) % 24) AS kst_hour,
    COUNT(*) AS requests FROM h GROUP BY h ORDER BY requests DESC, utc_hour LIMIT 1""",
)
def _(spark, folder):
    return prompts.peak_hour(views.prompts(spark, folder))


_CONTEXT = ("usage_percent", "daily_average", "daily_percent")


@query(
    "met_05_context_use",
    _V + f""", t AS (SELECT {_TOTAL} FROM v4) SELECT total_tokens,
    round(total_tokens / 200000 * 100, 6) AS usage_percent,
    round(total_tokens / {DAYS}, 6) AS daily_average,
    round(total_tokens / {DAYS} / 200000 * 100, 6) AS daily_percent FROM t""",
)
def _(spark, folder):
    total = prompts.totals(views.prompts(spark, folder))
    return rounded(estimates.context_use(total, "total_tokens", DAYS), 6, *_CONTEXT)


@query(
    "met_05_context_use_by_conversation",
    _V + f""", t AS (SELECT conversation_id, {_TOTAL} FROM v4 WHERE conversation_id IS NOT NULL
      GROUP BY conversation_id)
    SELECT conversation_id, total_tokens, round(total_tokens / 200000 * 100, 6) AS usage_percent,
    CAST(total_tokens AS DOUBLE) AS daily_average, round(total_tokens / 200000 * 100, 6) AS daily_percent
    FROM t""",
)
def _(spark, folder):
    conversations = prompts.by_conversation(views.chat_prompts(spark, folder))
    use = estimates.context_use(conversations, "total_tokens", 1, keep=("conversation_id",))
    return rounded(use, 6, *_CONTEXT)


@query(
    "met_06_prompt_types",
    _V + f""", t AS (SELECT type, {_SUMS} FROM v4 GROUP BY type)
    SELECT *, round(requests / (SELECT COUNT(*) FROM v4) * 100, 6) AS percent,
    round(input_tokens / requests, 6) AS avg_input, round(output_tokens / requests, 6) AS avg_output,
    round((input_tokens + output_tokens) / requests, 6) AS avg_total FROM t""",
)
def _(spark, folder):
    table = prompts.by_type(views.prompts(spark, folder))
    return rounded(table, 6, "percent", "avg_input", "avg_output", "avg_total")


@query(
    "met_04_virtual_cost_of_prompts",
    _V + f""", t AS (SELECT CAST(SUM(input_tokens) AS BIGINT) AS tin, CAST(SUM(output_tokens) AS BIGINT)
      AS tout FROM v4), """ + cost_sql("t", "tin", "tout", str(DAYS), ""),
)
def _(spark, folder):
    total = prompts.totals(views.prompts(spark, folder))
    costs = estimates.virtual_cost(total, "input_tokens", "output_tokens", F.lit(DAYS))
    return rounded(costs, 6, *COST_COLUMNS)


@query("ord_05_prompt_users", _V + f" SELECT user_id, {_SUMS}, {_TOTAL} FROM v4 GROUP BY user_id")
def _(spark, folder):
    return prompts.by_user(views.prompts(spark, folder))


@query(
    "ord_05_top_prompt_users",
    _V + f""", u AS (SELECT user_id, {_SUMS}, {_TOTAL} FROM v4 GROUP BY user_id)
    SELECT *, row_number() OVER (ORDER BY total_tokens DESC, user_id NULLS FIRST) AS rank FROM u
    ORDER BY rank LIMIT 3""",
)
def _(spark, folder):
    return prompts.top_users(views.prompts(spark, folder))
