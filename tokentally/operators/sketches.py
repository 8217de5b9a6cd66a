"""Summaries that merge: percentiles and distinct counts over any range, from sketches of hours and days.

The logs are read once to make the sketches, which may be stored; a range then only merges those of its
hours or days. Counts, sums, smallest and largest values are exact beside them.
"""

from collections.abc import Sequence
from datetime import date, datetime
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.periods import Period
from .activity import FEATURES, MEASURES

#: Size of the quantile sketches: exact up to so many values, and see `rank_error`.
SIZE_K = 4096
#: Logarithms of the sizes of the distinct-count sketches. Users of a range: 0.4 % off (one standard
#: deviation) when there are many, theta sketches exact up to 2**14 users and 0.8 % off beyond.
USERS_LG = 16
FEATURE_LG = 14
_APPLICATION = "application_name"


def rank_error(k: int = SIZE_K) -> float:
    """By how much the rank of a quantile is off at most, with 99 % confidence, as a part of all values."""
    return 2.296 / k**0.9021


def size_sketches(calls: DataFrame, k: int = SIZE_K) -> DataFrame:
    """application_name, hour (UTC), and a sketch, number, sum and extremes of the output sizes of its calls."""
    size = fields.output_tokens().cast("long")
    hour = fields.utc_hour_start(fields.event_time()).alias("hour")
    return (
        calls.select(fields.metadata(_APPLICATION).alias(_APPLICATION), hour, size.alias("size"))
        .groupBy(_APPLICATION, "hour")
        .agg(
            F.kll_sketch_agg_bigint("size", k).alias("sizes"),
            F.count("size").alias("n"),
            F.sum("size").alias("total"),
            F.min("size").alias("least"),
            F.max("size").alias("most"),
        )
    )


def sizes_between(
    sketches: DataFrame, first: datetime | None = None, before: datetime | None = None, k: int = SIZE_K
) -> DataFrame:
    """Smallest, largest, mean, median and 95th percentile output per application, of the hours from `first`
    until `before`. Percentiles are sizes that occur; `rank_error` bounds how far off they are."""
    chosen = sketches
    if first is not None:
        chosen = chosen.where(F.col("hour") >= F.lit(first))
    if before is not None:
        chosen = chosen.where(F.col("hour") < F.lit(before))
    merged = chosen.groupBy(_APPLICATION).agg(
        F.kll_merge_agg_bigint(F.when(F.col("n") > 0, F.col("sizes")), k).alias("sizes"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("min_output"),
        F.max("most").alias("max_output"),
    )

    def quantile(rank: float):
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sizes", F.lit(rank)))

    return merged.select(
        _APPLICATION,
        "min_output",
        "max_output",
        F.try_divide("total", "n").alias("avg_output"),
        quantile(0.5).alias("median_output"),
        quantile(0.95).alias("p95_output"),
    )


def user_sketches(reports: DataFrame) -> DataFrame:
    """day, and sketches of its users and of those of each feature. Rows with a broken date are left out."""
    day = fields.report_day(F.col("Date")).alias("day")
    # A user without a report counts nowhere, so the sketches of a feature hold users with some of it.
    own = {
        name: F.when(F.col(MEASURES[measure]) > 0, F.col("UserId")) for name, measure in FEATURES.items()
    }
    return (
        reports.select(day, "UserId", *(c.alias(name) for name, c in own.items()))
        .where("day IS NOT NULL")
        .groupBy("day")
        .agg(
            F.hll_sketch_agg("UserId", USERS_LG).alias("users"),
            *(F.theta_sketch_agg(F.col(f"`{name}`"), FEATURE_LG).alias(name) for name in own),
        )
    )


def users_between(sketches: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """start, end, unique_users of each period; 0 without a report. Periods may overlap."""
    spark = sketches.sparkSession
    own = [(p.start, p.end) for p in dict.fromkeys(periods)]
    wanted = spark.createDataFrame(own, "start date, end date")
    listed = F.array(*(F.struct(F.lit(first).alias("start"), F.lit(last).alias("end")) for first, last in own))
    if not own:
        return wanted.withColumn("unique_users", F.lit(0).cast("long"))
    inside = F.filter(listed, lambda p: F.col("day").between(p["start"], p["end"]))
    found = (
        sketches.select(F.inline(inside), "users")
        .groupBy("start", "end")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"))
    )
    return wanted.join(found, ["start", "end"], "left").na.fill(0, ["unique_users"])


def shared_users(sketches: DataFrame, start: date, end: date) -> DataFrame:
    """feature_a, feature_b, users_a, users_b, shared_users: how many users of a range have used both."""
    days = sketches.where(F.col("day").between(F.lit(start), F.lit(end)))
    names = list(FEATURES)
    whole = days.agg(*(F.theta_union_agg(F.col(f"`{n}`"), FEATURE_LG).alias(f"f{k}") for k, n in enumerate(names)))
    rows = []
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        both = F.theta_intersection(F.col(f"f{i}"), F.col(f"f{j}"))
        counts = [F.theta_sketch_estimate(c) for c in (F.col(f"f{i}"), F.col(f"f{j}"), both)]
        named = zip(counts, ("users_a", "users_b", "shared_users"), strict=True)
        rows.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), *(c.alias(n) for c, n in named)))
    return whole.select(F.inline(F.array(*rows)))
