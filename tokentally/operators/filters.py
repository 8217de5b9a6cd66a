"""Row filters. User input is bound as literals, never spliced into SQL text."""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LARGE_REQUEST_TOKENS
from ..functions import fields


def in_days(df: DataFrame, start: date, end: date) -> DataFrame:
    """Calls of the days `start` to `end`, both included, by partition keys."""
    first, last = (int(f"{day:%Y%m%d}") for day in (start, end))
    return df.where(fields.partition_number().between(first, last))


def on_day(df: DataFrame, day: date) -> DataFrame:
    """Calls of one day, by equality on each (zero-padded) partition key."""
    return df.where(
        (F.lpad("year", 4, "0") == F.lit(f"{day:%Y}"))
        & (F.lpad("month", 2, "0") == F.lit(f"{day:%m}"))
        & (F.lpad("day", 2, "0") == F.lit(f"{day:%d}"))
    )


def in_report_days(df: DataFrame, start: date, end: date) -> DataFrame:
    """Activity rows of the days `start` to `end`; rows with a broken date are left out."""
    return df.where(fields.report_day(F.col("Date")).between(F.lit(start), F.lit(end)))


def like_pattern(column: Column, pattern: str) -> Column:
    """Case-sensitive LIKE on both sides open; `_` and `%` in the pattern are wildcards."""
    return column.like("%" + pattern.replace("\\", "\\\\") + "%")


def by_arn(df: DataFrame, pattern: str | None) -> DataFrame:
    """Calls whose identity matches; no or empty pattern keeps all."""
    return df.where(like_pattern(F.col("identity.arn"), pattern)) if pattern else df


def by_user(df: DataFrame, pattern: str | None) -> DataFrame:
    """Activity rows whose user matches; no or empty pattern keeps all."""
    return df.where(like_pattern(F.col("UserId"), pattern)) if pattern else df


def by_prompt_user(df: DataFrame, text: str | None) -> DataFrame:
    """Prompts whose user contains the text in any case; prompts without a user stay."""
    if not text:
        return df
    user = F.col("user_id")
    return df.where(F.lower(user).contains(text.lower()) | user.isNull() | (user == ""))


def by_type(df: DataFrame, kind: str | None) -> DataFrame:
    """Prompts of one kind (`chat` or `inline`); none given keeps both."""
    return df.where(F.col("type") == kind) if kind else df


def by_application(df: DataFrame, name: str) -> DataFrame:
    return df.where(fields.metadata("application_name") == name)


def by_tenant_regex(df: DataFrame, regex: str = "tenant-") -> DataFrame:
    """Calls whose tenant contains a match of the expression."""
    return df.where(fields.metadata("tenant_id").rlike(regex))


def with_tenant(df: DataFrame) -> DataFrame:
    return df.where(fields.metadata("tenant_id").isNotNull())


def heavy_requests(df: DataFrame, environment: str, application: str, tokens: int) -> DataFrame:
    """Calls of one application and environment with more than `tokens` tokens in total."""
    return df.where(
        (fields.metadata("environment") == environment)
        & (fields.metadata("application_name") == application)
        & (fields.total_tokens() > tokens)
    )


def large_requests(df: DataFrame, tokens: int = LARGE_REQUEST_TOKENS) -> DataFrame:
    """Calls with more than `tokens` tokens in, or out."""
    return df.where((fields.input_tokens() > tokens) | (fields.output_tokens() > tokens))


def in_event_time(df: DataFrame, first: datetime, before: datetime) -> DataFrame:
    """Calls with `first <= event time < before`; both bounds carry their zone."""
    time = fields.event_time()
    low = F.timestamp_millis(F.lit(int(first.timestamp() * 1000)))
    high = F.timestamp_millis(F.lit(int(before.timestamp() * 1000)))
    return df.where((time >= low) & (time < high))


def charged(df: DataFrame) -> DataFrame:
    """Billing groups with a cost above 0."""
    return df.where(F.col("cost") > 0)
