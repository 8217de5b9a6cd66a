"""Queries over plain invocation records."""

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import fields
from ..functions.periods import resolve_period
from ..operators import filters, invocations, pricing
from ..sources import sinks, tables
from . import views
from .registry import query, rounded

# The period of most queries: all days of the table.
START, END = date(2024, 1, 1), date(2024, 1, 31)
EDGE_START, EDGE_END = date(2023, 12, 28), date(2024, 1, 3)
PATTERNS = ("CustomerService", "DataAnalysis", "Chatbot", "DocumentProcessor")

_V = "WITH" + views.SQL_INVOCATIONS
_VP = _V + "," + views.SQL_PRICES
_SUMS = (
    "COUNT(*) AS call_count, CAST(COALESCE(SUM(tin), 0) AS BIGINT) AS total_input_tokens, "
    "CAST(COALESCE(SUM(tout), 0) AS BIGINT) AS total_output_tokens"
)
_DAYS = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
_COST = "total_input_tokens * pin / 1000 + total_output_tokens * pout / 1000"
_FLAT = "total_input_tokens * 0.00025::DOUBLE / 1000 + total_output_tokens * 0.00125::DOUBLE / 1000"


def _calls(spark, folder):
    calls = views.invocations(spark, folder, START, END)
    return filters.in_days(calls, START, END)


def _cells(spark, folder):
    return invocations.as_cells(_calls(spark, folder))


def _cents(df, name="estimated_cost_usd"):
    """Costs rounded to eight decimals, the precision the price list allows."""
    return rounded(df, 8, name)


@query("src_08_row_count", "SELECT COUNT(*) AS row_count FROM events")
def _(spark, folder):
    return tables.row_count(views.invocations(spark, folder))


@query(
    "flt_13_one_day_count",
    "SELECT COUNT(*) AS row_count FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'",
)
def _(spark, folder):
    day = date(2024, 1, 9)
    return tables.row_count(views.invocations(spark, folder, day, day), day)


@query(
    "flt_01_day_range",
    _V + """ SELECT request_id, year, month, day FROM v1
    WHERE date BETWEEN DATE '2023-12-28' AND DATE '2024-01-03'""",
)
def _(spark, folder):
    calls = views.invocations(spark, folder, EDGE_START, EDGE_END)
    rows = filters.in_days(calls, EDGE_START, EDGE_END)
    return rows.select(F.col("requestId").alias("request_id"), "year", "month", "day")


@query("flt_03_arn_pattern", _V + " SELECT request_id, arn FROM v1 WHERE arn LIKE '%Service_Role%'")
def _(spark, folder):
    rows = filters.by_arn(views.invocations(spark, folder), "Service_Role")
    return rows.select(F.col("requestId").alias("request_id"), F.col("identity.arn").alias("arn"))


@query(
    "flt_15_relative_period",
    _V + f""" SELECT year, month, day, {_SUMS} FROM v1
    WHERE date BETWEEN DATE '2024-01-17' AND DATE '2024-01-24' GROUP BY year, month, day""",
)
def _(spark, folder):
    period = resolve_period(datetime(2024, 1, 24, 15, 30), days=7)
    calls = views.invocations(spark, folder, period.start, period.end)
    rows = filters.in_days(calls, period.start, period.end)
    return invocations.by_day(invocations.as_cells(rows))


@query("prj_02_identity_label", _V + " SELECT request_id, arn, label FROM v1m")
def _(spark, folder):
    arn = F.col("identity.arn")
    return views.invocations(spark, folder).select(
        F.col("requestId").alias("request_id"),
        arn.alias("arn"),
        fields.identity_label(arn).alias("label"),
    )


@query("prj_03_model_name", _V + " SELECT request_id, model_id, model_name FROM v1m")
def _(spark, folder):
    model = F.col("modelId")
    return views.invocations(spark, folder).select(
        F.col("requestId").alias("request_id"),
        model.alias("model_id"),
        fields.model_name(model).alias("model_name"),
    )


@query(
    "prj_04_price_key",
    _VP + """ SELECT m.model_name, m.price_key, COUNT(*) AS call_count FROM v1m v
    JOIN model_names m ON v.model_name IS NOT DISTINCT FROM m.model_name GROUP BY ALL""",
)
def _(spark, folder):
    calls = views.invocations(spark, folder)
    models = calls.groupBy(fields.model_name(F.col("modelId")).alias("model_name"))
    counted = models.agg(F.count(F.lit(1)).alias("call_count"))
    return counted.withColumn("price_key", fields.price_key(F.col("model_name")))


@query(
    "prj_07_day_display",
    _V + f" SELECT strftime(date, '%Y-%m-%d') AS date, {_SUMS} FROM v1 WHERE {_DAYS} GROUP BY 1",
)
def _(spark, folder):
    return invocations.day_display(invocations.by_day(_cells(spark, folder)))


@query(
    "prj_07_hour_display",
    _V + f" SELECT strftime(ts, '%Y-%m-%d %H:00') AS datetime, {_SUMS} FROM v1 WHERE {_DAYS} GROUP BY 1",
)
def _(spark, folder):
    return invocations.hour_display(invocations.by_hour(_cells(spark, folder)))


_EMPTY = date(2023, 5, 1)


@query(
    "prj_09_empty_summary",
    """SELECT COUNT(*) AS total_calls, CAST(0 AS BIGINT) AS total_input_tokens,
    CAST(0 AS BIGINT) AS total_output_tokens, CAST(0 AS DOUBLE) AS total_cost_usd
    FROM events WHERE CAST(ts AS DATE) = DATE '2023-05-01'""",
)
def _(spark, folder):
    calls = views.invocations(spark, folder, _EMPTY, _EMPTY)
    return invocations.totals(invocations.as_cells(filters.in_days(calls, _EMPTY, _EMPTY)))


_BY_MODEL = f"""g AS (SELECT model_id, model_name, {_SUMS},
    AVG(CAST(tin AS DOUBLE)) AS avg_input_tokens, AVG(CAST(tout AS DOUBLE)) AS avg_output_tokens
  FROM v1m WHERE {_DAYS} GROUP BY model_id, model_name)"""


@query(
    "agg_04_usage_by_model",
    _VP + f""", {_BY_MODEL} SELECT g.model_id, g.model_name, call_count,
    round(avg_input_tokens, 6) AS avg_input_tokens, round(avg_output_tokens, 6) AS avg_output_tokens,
    total_input_tokens, total_output_tokens, round({_COST}, 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    table = invocations.by_model(_cells(spark, folder))
    return _cents(rounded(table, 6, "avg_input_tokens", "avg_output_tokens"))


@query(
    "agg_01_total_usage",
    _VP + f""", {_BY_MODEL} SELECT CAST(SUM(call_count) AS BIGINT) AS total_calls,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS total_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    return _cents(invocations.totals(_cells(spark, folder)), "total_cost_usd")


@query(
    "agg_01_total_usage_by_arn_pattern",
    _VP + f""", g AS (SELECT model_name, {_SUMS} FROM v1m WHERE {_DAYS}
      AND arn LIKE '%DataAnalysis%' GROUP BY model_name)
    SELECT CAST(SUM(call_count) AS BIGINT) AS total_calls,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS total_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    rows = filters.by_arn(_calls(spark, folder), "DataAnalysis")
    return _cents(invocations.totals(invocations.as_cells(rows)), "total_cost_usd")


_BY_ARN = f"g AS (SELECT arn, label, {_SUMS} FROM v1m WHERE {_DAYS} GROUP BY arn, label)"


@query(
    "agg_02_usage_by_identity",
    _V + f""", {_BY_ARN} SELECT arn, label AS user_or_app, call_count, total_input_tokens,
    total_output_tokens, round({_FLAT}, 8) AS estimated_cost_usd FROM g""",
)
def _(spark, folder):
    return _cents(invocations.by_identity(_cells(spark, folder)))


@query(
    "joi_03_exact_cost_by_label",
    _VP + f""", g AS (SELECT label, model_name, {_SUMS} FROM v1m WHERE {_DAYS} GROUP BY label, model_name)
    SELECT label AS user_or_app, CAST(SUM(call_count) AS BIGINT) AS call_count,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name GROUP BY label""",
)
def _(spark, folder):
    return _cents(invocations.by_label(_cells(spark, folder)))


@query(
    "joi_03_flat_cost",
    _V + f""", g AS (SELECT label, {_SUMS} FROM v1m GROUP BY label)
    SELECT label AS user_or_app, call_count, total_input_tokens, total_output_tokens,
    round({_FLAT}, 8) AS estimated_cost_usd FROM g""",
)
def _(spark, folder):
    cells = invocations.as_cells(views.invocations(spark, folder))
    label = fields.identity_label(F.col("arn")).alias("user_or_app")
    sums = cells.groupBy(label).agg(
        *[
            F.sum(name).alias(name)
            for name in ("call_count", "total_input_tokens", "total_output_tokens")
        ]
    )
    return _cents(pricing.with_flat_cost(sums))


_BY_ARN_MODEL = f"""g AS (SELECT arn, label, model_id, model_name, {_SUMS} FROM v1m
  WHERE {_DAYS} GROUP BY ALL)"""


@query(
    "agg_03_usage_by_identity_model",
    _VP + f""", {_BY_ARN_MODEL} SELECT arn, model_id, label AS user_or_app, g.model_name, call_count,
    total_input_tokens, total_output_tokens, round({_COST}, 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    return _cents(invocations.by_identity_model(_cells(spark, folder)))


@query(
    "ord_01_identities_in_order",
    _V + f", {_BY_ARN} SELECT label AS user_or_app, call_count FROM g ORDER BY call_count DESC, arn",
)
def _(spark, folder):
    return invocations.by_identity(_cells(spark, folder)).select("user_or_app", "call_count")


@query(
    "agg_05_usage_by_day",
    _V + f" SELECT year, month, day, {_SUMS} FROM v1 WHERE {_DAYS} GROUP BY year, month, day",
)
def _(spark, folder):
    return invocations.by_day(_cells(spark, folder))


@query(
    "agg_06_usage_by_hour",
    _V + f""" SELECT year, month, day, strftime(ts, '%H') AS hour, {_SUMS} FROM v1
    WHERE {_DAYS} GROUP BY year, month, day, strftime(ts, '%H')""",
)
def _(spark, folder):
    return invocations.by_hour(_cells(spark, folder))


@query(
    "ord_07_peak_hour_of_calls",
    _V + f""" SELECT strftime(ts, '%H') AS hour, {_SUMS} FROM v1 GROUP BY 1
    ORDER BY call_count DESC, hour LIMIT 1""",
)
def _(spark, folder):
    return invocations.peak_hour(invocations.as_cells(views.invocations(spark, folder)))


@query(
    "joi_01_price_table_lookup",
    _VP + f""", g AS (SELECT model_name, {_SUMS} FROM v1m GROUP BY model_name)
    SELECT g.model_name, call_count, total_input_tokens, total_output_tokens,
    round({_COST}, 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    cells = invocations.as_cells(views.invocations(spark, folder))
    usage = cells.groupBy(fields.model_name(F.col("model_id")).alias("model_name")).agg(
        *[
            F.sum(name).alias(name)
            for name in ("call_count", "total_input_tokens", "total_output_tokens")
        ]
    )
    return _cents(pricing.with_table_cost(usage, pricing.price_table(spark), region="eu-central-1"))


@query(
    "joi_02_cost_in_unlisted_region",
    _VP + f""", {_BY_MODEL} SELECT g.model_name, round({_COST}, 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name""",
)
def _(spark, folder):
    table = invocations.by_model(_cells(spark, folder), region="sa-east-1")
    return _cents(table.select("model_name", "estimated_cost_usd"))


_BY_REGION = f"""g AS (SELECT region, model_name, {_SUMS} FROM v1m WHERE {_DAYS} GROUP BY ALL)
    SELECT region, CAST(SUM(call_count) AS BIGINT) AS call_count,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name"""


@query("agg_23_usage_by_region", _VP + f", {_BY_REGION} GROUP BY region")
def _(spark, folder):
    return _cents(invocations.by_region(_cells(spark, folder)))


@query(
    "set_03_regions_side_by_side",
    _VP + f", {_BY_REGION} WHERE region IN ('us-east-1', 'ap-northeast-1', 'ap-northeast-2') GROUP BY region",
)
def _(spark, folder):
    asked = ("us-east-1", "ap-northeast-1", "ap-northeast-2")
    rows = _cells(spark, folder).where(F.col("region").isin(*asked))
    return _cents(invocations.by_region(rows))


@query(
    "agg_23_same_usage_in_all_regions",
    _VP + f""", {_BY_MODEL}, t AS (SELECT SUM(total_input_tokens) AS tin, SUM(total_output_tokens) AS tout,
      SUM({_COST}) AS cost FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name)
    SELECT region, CAST(tin AS BIGINT) AS total_input_tokens, CAST(tout AS BIGINT) AS total_output_tokens,
    round(cost, 8) AS estimated_cost_usd FROM t, (VALUES ('us-east-1'), ('us-west-2'), ('eu-central-1'),
      ('ap-northeast-1'), ('ap-northeast-2'), ('ap-southeast-1')) r(region)""",
)
def _(spark, folder):
    return _cents(invocations.priced_in_regions(_cells(spark, folder)))


@query(
    "agg_24_usage_by_pattern",
    _VP + f""", g AS (SELECT p.pattern, v.model_name, COUNT(v.arn) AS call_count,
      CAST(COALESCE(SUM(tin), 0) AS BIGINT) AS total_input_tokens,
      CAST(COALESCE(SUM(tout), 0) AS BIGINT) AS total_output_tokens
      FROM (VALUES ('CustomerService'), ('DataAnalysis'), ('Chatbot'), ('DocumentProcessor')) p(pattern)
      LEFT JOIN (SELECT * FROM v1m WHERE {_DAYS}) v ON v.arn LIKE '%' || p.pattern || '%' GROUP BY ALL)
    SELECT pattern, CAST(SUM(call_count) AS BIGINT) AS call_count,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name GROUP BY pattern""",
)
def _(spark, folder):
    return _cents(invocations.by_pattern(_cells(spark, folder), PATTERNS))


_USER_PATTERN = """CASE user_id % 4 WHEN 0 THEN 'dev' || user_id WHEN 1 THEN 'Analysis-Role/s' || user_id
  WHEN 2 THEN 'Cust%Role/s' || (user_id % 100) || '_' ELSE 'nobody-' || user_id END"""


@query(
    "agg_24_usage_by_many_patterns",
    _VP + f""", patterns AS (SELECT DISTINCT {_USER_PATTERN} AS pattern FROM events
      UNION SELECT unnest(['%', '_', 'Chatbot', 'user/dev_'])),
    arns AS (SELECT arn, model_name, COUNT(*) AS n, SUM(tin) AS tin, SUM(tout) AS tout FROM v1m WHERE {_DAYS} GROUP BY 1, 2),
    g AS (SELECT p.pattern, v.model_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS call_count,
      CAST(COALESCE(SUM(tin), 0) AS BIGINT) AS total_input_tokens,
      CAST(COALESCE(SUM(tout), 0) AS BIGINT) AS total_output_tokens
      FROM patterns p LEFT JOIN arns v ON v.arn LIKE '%' || p.pattern || '%' GROUP BY ALL)
    SELECT pattern, CAST(SUM(call_count) AS BIGINT) AS call_count,
    CAST(SUM(total_input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(SUM(total_output_tokens) AS BIGINT) AS total_output_tokens,
    round(SUM({_COST}), 8) AS estimated_cost_usd
    FROM g JOIN unit u ON g.model_name IS NOT DISTINCT FROM u.model_name GROUP BY pattern""",
)
def _(spark, folder):
    """One pattern for each user of the events, and some with wildcards only."""
    own = views.table(spark, folder, "events").select(F.expr(_USER_PATTERN).alias("pattern"))
    more = spark.createDataFrame([("%",), ("_",), ("Chatbot",), ("user/dev_",)], "pattern string")
    return _cents(invocations.by_pattern_table(_cells(spark, folder), own.union(more)))


@query(
    "agg_25_calendar_trends",
    _V + " UNION ALL ".join(
        f" SELECT '{grain}' AS grain, CAST(date_trunc('{grain}', date) AS DATE) AS period_start, {_SUMS} "
        "FROM v1 GROUP BY 1, 2"
        for grain in ("week", "month", "quarter")
    ),
)
def _(spark, folder):
    return invocations.by_calendar(invocations.as_cells(views.invocations(spark, folder)))


@query(
    "win_01_month_to_date",
    _V + f""", d AS (SELECT date, {_SUMS} FROM v1 GROUP BY date)
    SELECT *, CAST(SUM(call_count) OVER w AS BIGINT) AS month_calls,
      CAST(SUM(total_input_tokens) OVER w AS BIGINT) AS month_input_tokens,
      CAST(SUM(total_output_tokens) OVER w AS BIGINT) AS month_output_tokens
    FROM d WINDOW w AS (PARTITION BY date_trunc('month', date) ORDER BY date)""",
)
def _(spark, folder):
    return invocations.month_to_date(invocations.as_cells(views.invocations(spark, folder)))


_TOP = f""", {_BY_ARN}, c AS (SELECT arn, label AS user_or_app, call_count, total_input_tokens,
    total_output_tokens, {_FLAT} AS estimated_cost_usd FROM g)
    SELECT * REPLACE (round(estimated_cost_usd, 8) AS estimated_cost_usd) FROM c"""


@query("ord_04_top_identities", _V + f"{_TOP} ORDER BY call_count DESC, arn LIMIT 10")
def _(spark, folder):
    return _cents(invocations.top_identities(_cells(spark, folder)))


@query(
    "ord_04_top_identities_by_cost",
    _V + f"{_TOP} ORDER BY c.estimated_cost_usd DESC, arn LIMIT 10",
)
def _(spark, folder):
    return _cents(invocations.top_identities(_cells(spark, folder), by="estimated_cost_usd"))


@query(
    "met_07_call_share_by_model",
    _V + f""" SELECT model_name, COUNT(*) AS call_count,
    round(COUNT(*) / (SELECT COUNT(*) FROM v1 WHERE {_DAYS}), 8) AS share
    FROM v1m WHERE {_DAYS} GROUP BY model_name""",
)
def _(spark, folder):
    table = invocations.by_model(_cells(spark, folder)).select("model_name", "call_count")
    return _cents(invocations.with_share(table, "call_count"), "share")


@query(
    "snk_03_preview",
    _V + f""", {_BY_ARN} SELECT arn, label AS user_or_app, call_count, total_input_tokens,
    total_output_tokens, round({_FLAT}, 8) AS estimated_cost_usd FROM g
    ORDER BY call_count DESC, arn LIMIT 20""",
)
def _(spark, folder):
    return _cents(sinks.preview(invocations.by_identity(_cells(spark, folder)), 20))
