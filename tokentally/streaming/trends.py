"""Windowed usage. Each function takes a batch or a streaming frame."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALARM_TOKENS_PER_HOUR
from ..functions import fields

# How late records come: minutes on the live path, up to hours in the archive.
LIVE_DELAY = "10 minutes"
ARCHIVE_DELAY = "2 hours"

_LAG_PERCENTILES = (0.5, 0.95)


def with_event_time(calls: DataFrame, delay: str | None = None) -> DataFrame:
    """Add `event_time`; with a delay also the watermark that bounds a stream's state."""
    timed = calls.withColumn("event_time", fields.event_time())
    return timed.withWatermark("event_time", delay) if delay else timed


def usage_trend(timed: DataFrame, every: str = "1 hour", **more: Column) -> DataFrame:
    """Tokens and requests per application in tumbling windows, and `more` aggregates by their names."""
    return (
        timed.groupBy(
            F.window("event_time", every).alias("w"),
            fields.metadata("application_name").alias("application_name"),
        )
        .agg(
            F.sum(fields.total_tokens()).alias("total_tokens"),
            F.count(F.lit(1)).alias("requests"),
            *(column.alias(name) for name, column in more.items()),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "application_name",
            "total_tokens",
            "requests",
            *more,
        )
    )


def token_alarms(timed: DataFrame, threshold: int = ALARM_TOKENS_PER_HOUR) -> DataFrame:
    """Applications and hours with more tokens than the threshold."""
    return usage_trend(timed, "1 hour").where(F.col("total_tokens") > threshold)


def running_totals(timed: DataFrame) -> DataFrame:
    """Tokens and requests per application so far; for `complete` or `update` mode."""
    return timed.groupBy(fields.metadata("application_name").alias("application_name")).agg(
        F.sum(fields.total_tokens()).alias("total_tokens"),
        F.count(F.lit(1)).alias("requests"),
    )


def newest_window_first(trend: DataFrame) -> DataFrame:
    """Batch only: a trend with the newest window on top."""
    return trend.orderBy(F.desc("window_start"), "application_name")


def ingestion_lag(events: DataFrame) -> DataFrame:
    """Seconds between event and ingestion of each log event."""
    lag = F.unix_millis("ingestion_time") - F.unix_millis("event_time")
    return events.withColumn("lag_seconds", lag / F.lit(1000.0))


def lag_by_hour(events: DataFrame) -> DataFrame:
    """Exact median, 95th percentile and largest lag per hour (UTC): the basis for a watermark.

    Equal lags are counted first, then lags of one second together. Running counts over the seconds of
    an hour tell in which of them a percentile lies; only those are looked into. So a task holds the
    seconds of an hour, or the milliseconds of a second, never an hour's events.
    """
    lag = F.unix_millis("ingestion_time") - F.unix_millis("event_time")
    counted = (
        events.select(fields.utc_hour_start(F.col("event_time")).alias("hour"), lag.alias("lag"))
        .groupBy("hour", "lag", F.floor(F.col("lag") / 1000).alias("second"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    timed = F.when(F.col("second").isNotNull(), F.col("n")).otherwise(0)
    seconds = counted.groupBy("hour", "second").agg(
        F.sum("n").alias("all"), F.sum(timed).alias("m"), F.max("lag").alias("max_lag")
    )
    of_hour = Window.partitionBy("hour")
    before = of_hour.orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    ranked = seconds.select(
        "hour",
        "second",
        "m",
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"),
        F.sum("all").over(of_hour).alias("events"),
        F.sum("m").over(of_hour).alias("total"),
        F.max("max_lag").over(of_hour).alias("max_lag"),
    )
    places = [(F.col("total") - 1) * q for q in _LAG_PERCENTILES]
    ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
    wanted = F.col("second").isNull()  # an hour whose lags are all unknown stays
    for rank in ranks:
        wanted = wanted | ((F.col("base") <= rank) & (rank < F.col("base") + F.col("m")))
    of_second = Window.partitionBy("hour", "second").orderBy("lag")
    first = F.col("base") + F.coalesce(
        F.sum("n").over(of_second.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    same = F.col("c.hour").eqNullSafe(F.col("r.hour")) & F.col("c.second").eqNullSafe(F.col("r.second"))
    inside = (
        counted.alias("c")
        .join(ranked.where(wanted).alias("r"), same)
        .select("c.hour", "c.second", "lag", "n", "base", "events", "total", "max_lag")
        .withColumn("first", first)
    )
    values = [
        F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("lag"))) for rank in ranks
    ]
    found = inside.groupBy("hour", "events", "total", "max_lag").agg(
        *(value.alias(f"v{k}") for k, value in enumerate(values))
    )

    def between(k: int) -> Column:
        low, high, place = F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}"), places[k]
        return (low + (high - low) * (place - F.floor(place))) / F.lit(1000.0)

    return found.select(
        "hour",
        "events",
        between(0).alias("median_lag"),
        between(1).alias("p95_lag"),
        (F.col("max_lag") / F.lit(1000.0)).alias("max_lag"),
    ).orderBy("hour")
