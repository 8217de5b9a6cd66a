"""Usage of models by identity, model, day, hour, region and application pattern."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_REGION, REGIONS
from ..functions import fields
from . import pricing
from .filters import like_pattern
from .patterns import matches

# Beyond so many patterns, names are looked up in an index instead of being compared with each.
MANY_PATTERNS = 50
# Sums in every usage table.
_SUMS = ("call_count", "total_input_tokens", "total_output_tokens")


def _reduced(cells: DataFrame, *keys: str) -> DataFrame:
    names = (*_SUMS, "input_count", "output_count")
    return cells.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in names))


def usage_cube(cells: DataFrame) -> DataFrame:
    """Sums by model, region, day and hour: few rows, for all tables without identities."""
    return _reduced(cells, "model_id", "region", "year", "month", "day", "hour")


def identity_sums(cells: DataFrame) -> DataFrame:
    """Sums by identity and model, for all tables of identities."""
    return _reduced(cells, "arn", "model_id")


def as_cells(df: DataFrame) -> DataFrame:
    """A log in the columns that all tables below use, one cell per call, nothing aggregated."""
    hit = F.lit(1).cast("bigint")
    return df.select(
        F.col("identity.arn").alias("arn"),
        F.col("modelId").alias("model_id"),
        "region",
        "year",
        "month",
        "day",
        fields.event_hour().alias("hour"),
        hit.alias("call_count"),
        F.when(fields.input_tokens().isNotNull(), hit).otherwise(0).alias("input_count"),
        F.when(fields.output_tokens().isNotNull(), hit).otherwise(0).alias("output_count"),
        fields.input_tokens().cast("bigint").alias("total_input_tokens"),
        fields.output_tokens().cast("bigint").alias("total_output_tokens"),
    )


def _sums() -> list[Column]:
    return [fields.or_zero(F.sum(name)).alias(name) for name in _SUMS]


def _per_model(cells: DataFrame, *keys: str) -> DataFrame:
    """Sums per keys and model. Rows are grouped by raw ids; names are made once per group."""
    grouped = cells.groupBy(*keys, "model_id").agg(*_sums())
    return grouped.withColumn("model_name", fields.model_name(F.col("model_id")))


def by_model(cells: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """Calls, token averages, token sums and cost per model id, most called first."""
    grouped = cells.groupBy("model_id").agg(
        *_sums(),
        F.try_divide(F.sum("total_input_tokens"), F.sum("input_count")).alias("avg_input_tokens"),
        F.try_divide(F.sum("total_output_tokens"), F.sum("output_count")).alias("avg_output_tokens"),
    )
    named = grouped.withColumn("model_name", fields.model_name(F.col("model_id")))
    return (
        pricing.with_cost(named, region=region)
        .select(
            "model_id", "model_name", "call_count", "avg_input_tokens", "avg_output_tokens",
            "total_input_tokens", "total_output_tokens", "estimated_cost_usd",
        )
        .orderBy(F.desc("call_count"), "model_id")
    )


def totals(cells: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """One row: calls, tokens and the cost summed over models; zeros if there is no call."""
    return pricing.with_cost(_per_model(cells), region=region, exact=True).agg(
        fields.or_zero(F.sum("call_count")).alias("total_calls"),
        fields.or_zero(F.sum("total_input_tokens")).alias("total_input_tokens"),
        fields.or_zero(F.sum("total_output_tokens")).alias("total_output_tokens"),
        pricing.cost_sum().alias("total_cost_usd"),
    )


def by_identity(cells: DataFrame) -> DataFrame:
    """Usage per full ARN with its label and the flat cost, most calls first.

    Several sessions of one role are several rows with one label; see `by_label`.
    """
    grouped = cells.groupBy("arn").agg(*_sums())
    labelled = grouped.withColumn("user_or_app", fields.identity_label(F.col("arn")))
    return (
        pricing.with_flat_cost(labelled)
        .select("arn", "user_or_app", *_SUMS, "estimated_cost_usd")
        .orderBy(F.desc("call_count"), "arn")
    )


def by_label(cells: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """Usage per identity label, the sessions of a role merged, with cost from the real models."""
    labelled = cells.withColumn("user_or_app", fields.identity_label(F.col("arn")))
    priced = pricing.with_cost(_per_model(labelled, "user_or_app"), region=region, exact=True)
    return (
        priced.groupBy("user_or_app")
        .agg(*_sums(), pricing.cost_sum())
        .orderBy(F.desc("estimated_cost_usd"), "user_or_app")
    )


def by_identity_model(cells: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """Usage and cost per ARN and model id, by label, then most calls first."""
    named = _per_model(cells, "arn").withColumn(
        "user_or_app", fields.identity_label(F.col("arn"))
    )
    return (
        pricing.with_cost(named, region=region)
        .select("arn", "model_id", "user_or_app", "model_name", *_SUMS, "estimated_cost_usd")
        .orderBy("user_or_app", F.desc("call_count"), "arn", "model_id")
    )


def by_day(cells: DataFrame) -> DataFrame:
    """Usage per day, in order of days."""
    return (
        cells.groupBy("year", "month", "day").agg(*_sums()).orderBy(fields.partition_number())
    )


def by_hour(cells: DataFrame) -> DataFrame:
    """Usage per day and hour: the day is the partition's, the hour the event's (UTC)."""
    return (
        cells.groupBy("year", "month", "day", "hour")
        .agg(*_sums())
        .withColumn("hour", fields.two_digits(F.col("hour")))
        .orderBy(fields.partition_number(), "hour")
    )


def peak_hour(cells: DataFrame) -> DataFrame:
    """The hour of day (UTC) with the most calls; the earliest of equals."""
    hours = cells.groupBy("hour").agg(*_sums())
    return (
        hours.withColumn("hour", fields.two_digits(F.col("hour")))
        .orderBy(F.desc("call_count"), "hour")
        .limit(1)
    )


def day_display(daily: DataFrame) -> DataFrame:
    """Daily table with `yyyy-MM-dd` text in place of the partition keys."""
    text = F.date_format(fields.partition_day(), "yyyy-MM-dd")
    return daily.select(text.alias("date"), *_SUMS).orderBy("date")


def hour_display(hourly: DataFrame) -> DataFrame:
    """Hourly table with `yyyy-MM-dd HH:00` text in place of the partition keys."""
    day = F.date_format(fields.partition_day(), "yyyy-MM-dd")
    text = F.concat(day, F.lit(" "), F.col("hour"), F.lit(":00"))
    return hourly.select(text.alias("datetime"), *_SUMS).orderBy("datetime")


def by_region(cells: DataFrame) -> DataFrame:
    """Usage per region at that region's prices, most calls first."""
    priced = pricing.with_cost_by_region(_per_model(cells, "region"), exact=True)
    return (
        priced.groupBy("region")
        .agg(*_sums(), pricing.cost_sum())
        .orderBy(F.desc("call_count"), "region")
    )


def priced_in_regions(cells: DataFrame, regions: Sequence[str] = REGIONS) -> DataFrame:
    """What the same usage costs at each region's prices."""
    per_model = _per_model(cells)
    # Regions with the same price list share one look-up.
    units: dict[pricing.PriceList, str] = {}
    for region in regions:
        listed = pricing.price_list(region)
        if listed not in units:
            units[listed] = f"unit_{len(units)}"
            per_model = per_model.withColumn(
                units[listed], pricing.price(F.col("model_name"), listed)
            )
    tokens = (F.col("total_input_tokens"), F.col("total_output_tokens"))
    costs = [
        F.struct(
            F.lit(region).alias("region"),
            pricing.cost(*tokens, F.col(units[pricing.price_list(region)])).alias("cost"),
        )
        for region in regions
    ]
    return (
        per_model.select(*tokens, F.inline(F.array(*costs)))
        .groupBy("region")
        .agg(
            F.sum("total_input_tokens").alias("total_input_tokens"),
            F.sum("total_output_tokens").alias("total_output_tokens"),
            F.sum("cost").cast("double").alias("estimated_cost_usd"),
        )
        .orderBy("region")
    )


def by_pattern(
    cells: DataFrame, patterns: Sequence[str], region: str = DEFAULT_REGION
) -> DataFrame:
    """One summary per ARN pattern, in one pass; a pattern nobody matches is a row of zeros.

    A call counts for every pattern it matches, as in one run per pattern. Each cell is matched where
    it is read, and what is shuffled are sums per pattern and model. More than MANY_PATTERNS go through
    `by_pattern_table`.
    """
    named = list(dict.fromkeys(patterns))
    if len(named) > MANY_PATTERNS:
        table = cells.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
        found = by_pattern_table(cells, table, region)
        return table.join(found, "pattern").orderBy("pattern")
    hits = F.array(*(F.when(like_pattern(F.col("arn"), p), p) for p in named))
    matched = cells.select("model_id", *_SUMS, F.explode(hits).alias("pattern")).where("pattern is not null")
    priced = pricing.with_cost(_per_model(matched, "pattern"), region=region, exact=True)
    found = priced.groupBy("pattern").agg(*_sums(), pricing.cost_sum())
    wanted = cells.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    zeros = dict.fromkeys((*_SUMS, pricing.COST), 0)
    return wanted.join(found, "pattern", "left").fillna(zeros).orderBy("pattern")


def by_pattern_table(cells: DataFrame, patterns: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """`by_pattern` for a table of any number of patterns (`pattern`); null ones are left out.

    Calls are summed by identity and model first, so a busy identity is matched once.
    """
    sums = identity_sums(cells)
    hits = matches(sums.select(F.col("arn").alias("name")), patterns).withColumnRenamed("name", "arn")
    priced = pricing.with_cost(_per_model(sums.join(hits, "arn"), "pattern"), region=region, exact=True)
    found = priced.groupBy("pattern").agg(*_sums(), pricing.cost_sum())
    wanted = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    zeros = dict.fromkeys((*_SUMS, pricing.COST), 0)
    return wanted.join(found, "pattern", "left").fillna(zeros)


def _daily(cells: DataFrame) -> DataFrame:
    """Sums per date; grouped by a number, which is made a date once per group."""
    number = F.col("number")
    date = F.make_date(
        F.floor(number / 10000).cast("int"), F.floor(number / 100).cast("int") % 100, number % 100
    )
    grouped = cells.groupBy(fields.partition_number().alias("number")).agg(*_sums())
    return grouped.select(date.alias("date"), *_SUMS)


def by_calendar(cells: DataFrame, grains: Sequence[str] = ("week", "month", "quarter")) -> DataFrame:
    """Usage per week, month and quarter. The log is reduced to days first."""
    starts = [
        F.struct(
            F.lit(grain).alias("grain"), F.date_trunc(grain, "date").cast("date").alias("period_start")
        )
        for grain in grains
    ]
    return (
        _daily(cells)
        .select(*_SUMS, F.inline(F.array(*starts)))
        .groupBy("grain", "period_start")
        .agg(*_sums())
        .orderBy("grain", "period_start")
    )


def month_to_date(cells: DataFrame) -> DataFrame:
    """Daily usage with running sums within the month: windows of at most 31 rows."""
    month = F.date_trunc("month", "date").cast("date")
    window = (
        Window.partitionBy("month")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _daily(cells)
        .withColumn("month", month)
        .select(
            "date",
            *_SUMS,
            F.sum("call_count").over(window).alias("month_calls"),
            F.sum("total_input_tokens").over(window).alias("month_input_tokens"),
            F.sum("total_output_tokens").over(window).alias("month_output_tokens"),
        )
        .orderBy("date")
    )


def top_identities(cells: DataFrame, n: int = 10, by: str = "call_count") -> DataFrame:
    """The first `n` identities by calls, or by `estimated_cost_usd`."""
    return by_identity(cells).orderBy(F.desc(by), "arn").limit(n)


def with_share(df: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """Add each row's part of the column total; the total is a scalar sub-query, not one big window."""
    whole = df.agg(F.sum(measure)).scalar()
    return df.withColumn(name, fields.share(F.col(measure), whole))
