"""The same totals from metrics, log and bill, side by side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields

_MEASURES = ("invocations", "input_tokens", "output_tokens")

# Bills are summed in decimals: the result does not depend on the order of rows.
_MONEY = "decimal(28,10)"


def metric_totals(points: DataFrame) -> DataFrame:
    """Metric points summed per model; models without an invocation are left out."""
    grouped = points.groupBy("model").agg(
        *[F.sum(F.col(name).cast("bigint")).alias(name) for name in _MEASURES]
    )
    return grouped.where(F.col("invocations") > 0)


def log_columns() -> list[Column]:
    """The layout of the metric points, from a call."""
    return [
        fields.model_name(F.col("modelId")).alias("model"),
        F.lit(1).cast("bigint").alias("invocations"),
        fields.or_zero(fields.input_tokens()).cast("bigint").alias("input_tokens"),
        fields.or_zero(fields.output_tokens()).cast("bigint").alias("output_tokens"),
    ]


def log_totals(calls: DataFrame) -> DataFrame:
    """A log in the layout of the metric points: one row per call."""
    return calls.select(*log_columns())


def compare_sources(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """Per model: both sides' sums, log minus metrics, and whether they agree.

    Equivalent to a full outer join of the two sums, but as one aggregation over both sides: one
    shuffle of partial sums, a NULL model is a group, and a side without the model reads 0.
    """
    tagged = metrics.select(F.lit("metric").alias("side"), "model", *_MEASURES).unionByName(
        log.select(F.lit("log").alias("side"), "model", *_MEASURES)
    )

    def total(side: str, name: str) -> Column:
        value = F.when(F.col("side") == side, F.col(name))
        return fields.or_zero(F.sum(value)).alias(f"{side}_{name}")

    sums = tagged.groupBy("model").agg(
        *[total(side, name) for side in ("metric", "log") for name in _MEASURES]
    )
    differences = [
        (F.col(f"log_{name}") - F.col(f"metric_{name}")).alias(f"diff_{name}") for name in _MEASURES
    ]
    equal = F.lit(True)
    for name in _MEASURES:
        equal = equal & (F.col(f"log_{name}") == F.col(f"metric_{name}"))
    return sums.select("*", *differences, equal.alias("matches")).orderBy("model")


def match_rates(comparison: DataFrame) -> DataFrame:
    """One row per measure: totals, log in percent of metrics, difference in percent of the log."""
    rows = [
        F.struct(
            F.lit(name).alias("measure"),
            fields.or_zero(F.sum(f"metric_{name}")).alias("metric_total"),
            fields.or_zero(F.sum(f"log_{name}")).alias("log_total"),
        )
        for name in _MEASURES
    ]
    metric, log = F.col("metric_total"), F.col("log_total")
    return (
        comparison.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .withColumn("difference", metric - log)
        .withColumn("match_percent", fields.percent(log, metric))
        .withColumn("difference_percent", fields.percent(metric - log, log))
        .orderBy("measure")
    )


def compare_costs(billed: DataFrame, computed: DataFrame) -> DataFrame:
    """Per model: billed and computed cost, and whether they agree to six decimals.

    Both sides hold `model` and `cost`, in any number of rows. A model on one side only gets NULL
    on the other and does not match.
    """
    cost, none = F.col("cost").cast(_MONEY), F.lit(None).cast(_MONEY)
    tagged = billed.select("model", cost.alias("billed"), none.alias("computed")).unionByName(
        computed.select("model", none.alias("billed"), cost.alias("computed"))
    )
    sums = tagged.groupBy("model").agg(
        F.sum("billed").cast("double").alias("billed_cost"),
        F.sum("computed").cast("double").alias("computed_cost"),
    )
    difference = F.col("computed_cost") - F.col("billed_cost")
    return (
        sums.withColumn("difference", difference)
        .withColumn("matches", F.coalesce(F.round(F.abs(difference), 6) == 0, F.lit(False)))
        .orderBy("model")
    )


def _cost_sum() -> Column:
    return F.sum(F.col("cost").cast(_MONEY)).alias("cost")


def bill_by_usage_type(bill: DataFrame) -> DataFrame:
    """Cost per usage type, highest first, and the grand total with usage type NULL.

    The bill is summed per usage type before the rollup, which would otherwise double its rows.
    """
    per_type = bill.groupBy("usage_type").agg(_cost_sum())
    return (
        per_type.rollup("usage_type")
        .agg(
            F.sum("cost").cast("double").alias("cost"),
            (F.grouping("usage_type") == 1).alias("is_total"),
        )
        .orderBy("is_total", F.desc("cost"), "usage_type")
    )


def bill_by_day(bill: DataFrame) -> DataFrame:
    """Cost per day and usage type."""
    grouped = bill.groupBy("day", "usage_type").agg(_cost_sum())
    return grouped.withColumn("cost", F.col("cost").cast("double")).orderBy("day", "usage_type")
