"""Windowed queries, as batch and as streams over the same files."""

from pyspark.sql import functions as F

from ..streaming import jobs, trends
from . import views
from .registry import query, rounded

_V = "WITH" + views.SQL_INVOCATIONS
_TOKENS = "CAST(SUM(tin + tout) AS BIGINT) AS total_tokens, COUNT(*) AS requests"


def _trend_sql(unit: str) -> str:
    start = f"CAST(date_trunc('{unit}', ts) AS TIMESTAMP)"
    return _V + f""", w AS (SELECT {start} AS window_start, {start} + INTERVAL 1 {unit} AS window_end,
      application_name, {_TOKENS} FROM v1 GROUP BY ALL)"""


_WINDOW = ("window_start", "window_end", "application_name")


def _batch(spark, folder):
    return trends.with_event_time(views.invocations(spark, folder))


def _stream(spark, folder, delay=trends.ARCHIVE_DELAY):
    return trends.with_event_time(views.invocation_stream(spark, folder), delay)


@query("str_01_hourly_token_alarm", _trend_sql("hour") + " SELECT * FROM w WHERE total_tokens > 10000")
def _(spark, folder):
    return trends.token_alarms(_batch(spark, folder))


@query(
    "str_01_hourly_token_alarm_stream",
    _trend_sql("hour") + " SELECT * FROM w WHERE total_tokens > 10000",
)
def _(spark, folder):
    # An alarm is raised as soon as its window is over the threshold, not when the window closes.
    return jobs.run_available(trends.token_alarms(_stream(spark, folder)), "alarms", "update", _WINDOW)


@query("str_02_hourly_trend", _trend_sql("hour") + " SELECT * FROM w")
def _(spark, folder):
    return trends.newest_window_first(trends.usage_trend(_batch(spark, folder), "1 hour"))


@query("str_03_daily_trend", _trend_sql("day") + " SELECT * FROM w")
def _(spark, folder):
    return trends.usage_trend(_batch(spark, folder), "1 day")


@query("ord_06_daily_trend_newest_first", _trend_sql("day") + " SELECT * FROM w")
def _(spark, folder):
    return trends.newest_window_first(trends.usage_trend(_batch(spark, folder), "1 day"))


@query(
    "str_04_refreshed_totals_stream",
    _V + f" SELECT application_name, {_TOKENS} FROM v1 GROUP BY application_name",
)
def _(spark, folder):
    totals = trends.running_totals(_stream(spark, folder, None))
    return jobs.run_available(totals, "totals", "complete")


@query("str_05_hourly_windows_stream", _trend_sql("hour") + " SELECT * FROM w")
def _(spark, folder):
    return jobs.run_available(trends.usage_trend(_stream(spark, folder)), "trend", "update", _WINDOW)


@query(
    "str_06_ingestion_lag_by_hour",
    """WITH e AS (SELECT date_trunc('second', ts) AS t, (event_id % 23 * 700 + 500) / 1000.0::DOUBLE AS lag
      FROM events)
    SELECT CAST(date_trunc('hour', t) AS TIMESTAMP) AS hour, COUNT(*) AS events,
    round(quantile_cont(lag, 0.5), 6) AS median_lag, round(quantile_cont(lag, 0.95), 6) AS p95_lag,
    round(MAX(lag), 6) AS max_lag FROM e GROUP BY 1""",
)
def _(spark, folder):
    events = views.table(spark, folder, "events").select(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_time"),
        (F.col("event_id") % 23 * 700 + 500).alias("lag_ms"),
    )
    late = F.timestamp_millis(F.unix_millis("event_time") + F.col("lag_ms"))
    table = trends.lag_by_hour(events.withColumn("ingestion_time", late))
    return rounded(table, 6, "median_lag", "p95_lag", "max_lag")
