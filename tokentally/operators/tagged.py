"""Usage by request metadata: application, environment, tenant, user, cost centre, variant."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_REGION, FORBIDDEN_METADATA, REQUIRED_METADATA
from ..functions import fields
from . import filters, pricing

_APPLICATION = "application_name"


def _keys(*keys: str) -> list[Column]:
    return [fields.metadata(key).alias(key) for key in keys]


def _tokens() -> Column:
    return F.sum(fields.total_tokens()).alias("total_tokens")


def _requests() -> Column:
    return F.count(F.lit(1)).alias("requests")


def _average() -> Column:
    return F.avg(fields.total_tokens()).alias("avg_tokens")


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Tokens, requests and tokens per request by metadata keys, most tokens first.

    Calls without a key form a group of their own, with NULL.
    """
    grouped = df.groupBy(*_keys(*keys)).agg(_tokens(), _requests(), _average())
    return grouped.orderBy(F.desc("total_tokens"), *keys)


def by_application(df: DataFrame) -> DataFrame:
    """Input, output and total tokens, requests and average per application, most tokens first."""
    return (
        df.groupBy(*_keys(_APPLICATION))
        .agg(
            F.sum(fields.input_tokens()).alias("total_input_tokens"),
            F.sum(fields.output_tokens()).alias("total_output_tokens"),
            _tokens(),
            _requests(),
            _average(),
        )
        .orderBy(F.desc("total_tokens"), _APPLICATION)
    )


def by_application_environment(df: DataFrame) -> DataFrame:
    return by_keys(df, _APPLICATION, "environment")


def by_tenant_application(df: DataFrame, regex: str = "tenant-") -> DataFrame:
    return by_keys(filters.by_tenant_regex(df, regex), "tenant_id", _APPLICATION)


def by_tenant(df: DataFrame) -> DataFrame:
    return by_keys(df, "tenant_id")


def by_cost_center(df: DataFrame) -> DataFrame:
    return by_keys(df, "cost_center", "team").drop("avg_tokens")


def heavy_by_tenant(
    df: DataFrame,
    environment: str = "production",
    application: str = "CustomerServiceApp",
    tokens: int = 100,
) -> DataFrame:
    """Requests above a token count per tenant, of one application in one environment."""
    return by_keys(filters.heavy_requests(df, environment, application, tokens), "tenant_id")


def by_role(df: DataFrame) -> DataFrame:
    """Tokens and requests by identity, application and tenant."""
    keys = ("arn", _APPLICATION, "tenant_id")
    return (
        df.groupBy(F.col("identity.arn").alias("arn"), *_keys(*keys[1:]))
        .agg(_tokens(), _requests())
        .orderBy(F.desc("total_tokens"), *keys)
    )


def _named_percentiles(sizes: DataFrame) -> DataFrame:
    q = F.col("q")
    named = sizes.withColumns({"median_output": q[0], "p95_output": q[1]})
    return named.drop("q").orderBy(_APPLICATION)


def output_sizes(df: DataFrame) -> DataFrame:
    """Smallest, largest, mean, median and 95th percentile output per application; exact.

    Equal sizes are counted before the shuffle, so what reaches a group is at most one row per
    distinct size, however many calls a busy application has.
    """
    size = fields.output_tokens().alias("size")
    counted = df.groupBy(*_keys(_APPLICATION), size).agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy(_APPLICATION)
        .agg(
            F.min("size").alias("min_output"),
            F.max("size").alias("max_output"),
            F.try_divide(
                F.sum(F.col("size") * F.col("n")), F.sum(F.when(F.col("size").isNotNull(), F.col("n")))
            ).alias("avg_output"),
            F.percentile("size", F.lit([0.5, 0.95]), F.col("n")).alias("q"),
        )
        .transform(_named_percentiles)
    )


def output_sizes_approx(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Like `output_sizes` in one shuffle, with percentiles off by at most 1/accuracy in rank."""
    size = fields.output_tokens()
    quantiles = F.percentile_approx(size, [0.5, 0.95], accuracy)
    return (
        df.groupBy(*_keys(_APPLICATION))
        .agg(
            F.min(size).alias("min_output"),
            F.max(size).alias("max_output"),
            F.avg(size).alias("avg_output"),
            quantiles.alias("q"),
        )
        .transform(_named_percentiles)
    )


def tenant_bill(df: DataFrame, first: datetime, before: datetime) -> DataFrame:
    """Tokens per tenant in `first <= event time < before`."""
    grouped = filters.in_event_time(df, first, before).groupBy(*_keys("tenant_id"))
    return grouped.agg(_tokens()).orderBy(F.desc("total_tokens"), "tenant_id")


def by_variant(df: DataFrame, experiment: str) -> DataFrame:
    """Mean output and samples per variant of one experiment."""
    rows = df.where(fields.metadata("experiment_id") == experiment)
    grouped = rows.groupBy(*_keys("variant"))
    return grouped.agg(
        F.avg(fields.output_tokens()).alias("avg_output"), F.count(F.lit(1)).alias("samples")
    ).orderBy("variant")


def tenant_totals(df: DataFrame) -> DataFrame:
    """Tokens per tenant; calls without a tenant are left out."""
    grouped = filters.with_tenant(df).groupBy(*_keys("tenant_id"))
    return grouped.agg(_tokens()).orderBy("tenant_id")


def chargeback(df: DataFrame, *keys: str, region: str = DEFAULT_REGION) -> DataFrame:
    """Cost per metadata keys: token sums per key and model, priced, then summed per key."""
    per_model = df.groupBy(*_keys(*keys), "modelId").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(fields.input_tokens()).alias("total_input_tokens"),
        F.sum(fields.output_tokens()).alias("total_output_tokens"),
    )
    named = per_model.withColumn("model_name", fields.model_name(F.col("modelId")))
    return (
        pricing.with_cost(named, region=region, exact=True)
        .groupBy(*keys)
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("total_input_tokens").alias("total_input_tokens"),
            F.sum("total_output_tokens").alias("total_output_tokens"),
            pricing.cost_sum(),
        )
        .orderBy(F.desc("estimated_cost_usd"), *keys)
    )


def top_users(df: DataFrame, n: int = 10) -> DataFrame:
    """The `n` heaviest users, per tenant, by tokens."""
    keys = ("tenant_id", "user_id")
    grouped = df.groupBy(*_keys(*keys)).agg(_tokens(), _requests())
    return grouped.orderBy(F.desc("total_tokens"), *keys).limit(n)


def request_fields(df: DataFrame) -> DataFrame:
    """Flat view of the calls: time, id, application, model and tokens."""
    return df.select(
        "timestamp",
        "requestId",
        *_keys(_APPLICATION, "application_id", "environment", "tenant_id", "user_id"),
        F.col("modelId").alias("model_id"),
        fields.input_tokens().alias("input_tokens"),
        fields.output_tokens().alias("output_tokens"),
    )


def newest(df: DataFrame, n: int) -> DataFrame:
    """The `n` newest calls of a flat view: a top-n per task and a merge, no full sort."""
    return df.orderBy(F.desc("timestamp"), "requestId").limit(n)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), "requestId")


def metadata_violations(df: DataFrame) -> DataFrame:
    """Calls that lack a required metadata key or carry a forbidden one, with those keys."""
    sent = F.col("requestMetadata")
    # Conditions of their own stay in generated code; a filter over a list of keys would not.
    missing = [F.when(sent[key].isNull(), key) for key in REQUIRED_METADATA]
    unwanted = [F.when(sent[key].isNotNull(), key) for key in FORBIDDEN_METADATA]
    found = df.select(
        "requestId",
        F.concat_ws(",", *missing).alias("missing_keys"),
        F.concat_ws(",", *unwanted).alias("forbidden_keys"),
    )
    return found.where((F.col("missing_keys") != "") | (F.col("forbidden_keys") != ""))


def sizes_between(calls: DataFrame, first: datetime, before: datetime) -> DataFrame:
    """Smallest, largest, mean, median and 95th percentile output per application of the calls with
    `first <= event time < before`, all exact. A percentile q is the ceil(n * q)-th smallest size of the n
    calls with a size; an application whose calls have none gets NULLs."""
    size = fields.output_tokens().cast("long")
    rows = filters.in_event_time(calls, first, before).select(fields.metadata(_APPLICATION).alias(_APPLICATION), size.alias("size"))
    stats = rows.groupBy(_APPLICATION).agg(
        F.min("size").alias("min_output"),
        F.max("size").alias("max_output"),
        F.try_divide(F.sum("size"), F.count("size")).alias("avg_output"),
    )
    # Calls per size, then running counts over the sizes of an application: no call is held at once.
    app = Window.partitionBy(_APPLICATION)
    counted = rows.where(F.col("size").isNotNull()).groupBy(_APPLICATION, "size").agg(F.count(F.lit(1)).alias("c"))
    running = counted.select(
        _APPLICATION,
        "size",
        F.sum("c").over(app.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        "c",
        F.sum("c").over(app).alias("n"),
    )

    def quantile(q: float) -> Column:
        position = F.ceil(F.col("n") * F.lit(q))
        return F.max(F.when((F.col("upto") - F.col("c") < position) & (position <= F.col("upto")), F.col("size")))

    found = running.groupBy(F.col(_APPLICATION).alias("found")).agg(
        quantile(0.5).alias("median_output"), quantile(0.95).alias("p95_output")
    )
    return stats.join(found, stats[_APPLICATION].eqNullSafe(found["found"]), "left").select(
        _APPLICATION, "min_output", "max_output", "avg_output", "median_output", "p95_output"
    )
