"""Metrics and log side by side as streams: by model and hour, once both sides have closed the hour."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from .trends import ARCHIVE_DELAY

_MEASURES = ("invocations", "input_tokens", "output_tokens")


def _hourly(points: DataFrame, side: str, delay: str) -> DataFrame:
    """Sums by hour and model; `known` tells a model without a name from one with an empty name."""
    timed = points.withWatermark("event_time", delay)
    model = F.coalesce("model", F.lit("")).alias(f"{side}_model")
    sums = [F.sum(name).alias(f"{side}_{name}") for name in _MEASURES]
    return timed.groupBy(
        F.window("event_time", "1 hour").alias(f"{side}_hour"), model, F.col("model").isNotNull().alias(f"{side}_known")
    ).agg(*sums)


def compare_by_hour(
    metrics: DataFrame, log: DataFrame, metric_delay: str = ARCHIVE_DELAY, log_delay: str = ARCHIVE_DELAY
) -> DataFrame:
    """Per hour and model: both sides' sums, log minus metrics, and whether they agree; for append mode.

    Both sides hold `event_time`, `model` and the measures, in any number of rows. An hour is given out
    once the watermarks of both sides have passed it; a side without the model then reads 0. State is
    kept for open hours only, a row for each model and hour.
    """
    left, right = _hourly(metrics, "metric", metric_delay), _hourly(log, "log", log_delay)
    same = F.lit(True)
    for name in ("hour", "model", "known"):
        same = same & (F.col(f"metric_{name}") == F.col(f"log_{name}"))
    joined = left.join(right, same, "full")

    def either(name: str) -> Column:
        return F.coalesce(f"metric_{name}", f"log_{name}")

    totals = {f"{side}_{name}": fields.or_zero(F.col(f"{side}_{name}")) for side in ("metric", "log") for name in _MEASURES}
    hours = joined.select(
        either("hour")["start"].alias("hour"),
        F.when(either("known"), either("model")).alias("model"),
        *(column.alias(name) for name, column in totals.items()),
    )
    equal = F.lit(True)
    for name in _MEASURES:
        equal = equal & (F.col(f"log_{name}") == F.col(f"metric_{name}"))
    differences = [(F.col(f"log_{name}") - F.col(f"metric_{name}")).alias(f"diff_{name}") for name in _MEASURES]
    return hours.select("*", *differences, equal.alias("matches"))
