"""Column expressions over usage records. All of them stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHARS_PER_TOKEN, KST_OFFSET_HOURS


def input_tokens() -> Column:
    return F.col("input.inputTokenCount")


def output_tokens() -> Column:
    return F.col("output.outputTokenCount")


def total_tokens() -> Column:
    """Input plus output of one call; NULL if either is NULL."""
    return input_tokens() + output_tokens()


def metadata(key: str) -> Column:
    """One request-metadata value; NULL if the caller did not send the key."""
    return F.col("requestMetadata")[key]


def identity_label(arn: Column) -> Column:
    """`assumed-role/<role>`, `user/<name>`, `Unknown`; NULL if the text only looks like a user."""
    return (
        F.when(arn.contains("assumed-role"), F.regexp_substr(arn, F.lit("assumed-role/([^/]+)")))
        .when(arn.contains("user"), F.regexp_substr(arn, F.lit("user/([^/]+)")))
        .otherwise("Unknown")
    )


def model_name(model_id: Column) -> Column:
    """What follows the last slash of a model id; NULL if nothing does."""
    return F.nullif(F.substring_index(model_id, "/", -1), F.lit(""))


def price_key(model: Column) -> Column:
    """The part after the last dot and before the first `-v`; a name without dots is kept whole."""
    last = F.substring_index(model, ".", -1)
    return F.when(model.contains("."), F.substring_index(last, "-v", 1)).otherwise(model)


def partition_number() -> Column:
    """The string partition keys as the number yyyymmdd, padded or not.

    It orders days like `partition_day` and is much cheaper where the keys are plain columns. Where
    they are partition keys, a filter on it is evaluated on the partition values, so it prunes.
    """
    year, month, day = (F.col(key).try_cast("int") for key in ("year", "month", "day"))
    return year * 10000 + month * 100 + day


def partition_day() -> Column:
    """Date of the string partition keys."""
    text = F.concat(
        F.col("year"), F.lit("-"), F.lpad("month", 2, "0"), F.lit("-"), F.lpad("day", 2, "0")
    )
    return text.cast("date")


def event_time() -> Column:
    """Event time from the ISO-8601 text (never from the metadata, which holds local time)."""
    return F.to_timestamp("timestamp")


def event_hour() -> Column:
    """Hour of the event in UTC as a number, whatever the session's zone."""
    return utc_hour(event_time())


def utc_hour(time: Column) -> Column:
    """Hour of day in UTC: from the seconds since 1970, which no zone shifts."""
    return F.floor(F.pmod(F.unix_seconds(time), F.lit(86_400)) / F.lit(3600)).cast("int")


def utc_hour_start(time: Column) -> Column:
    """Start of the hour in UTC; zones with a half hour would start it elsewhere."""
    seconds = F.unix_seconds(time)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(3600)))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def report_day(text: Column) -> Column:
    """Date of an `MM-dd-yyyy` text; NULL if it is not one."""
    return F.try_to_date(text, "MM-dd-yyyy")


def whole_number(text: Column) -> Column:
    """Text as a whole number; broken or missing text counts as 0."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def text_tokens(text: Column) -> Column:
    """Rough token count of a text: one per three characters, 0 for no text."""
    length = or_zero(F.length(text)).cast("bigint")
    return F.floor(length / F.lit(CHARS_PER_TOKEN))


def joined_completions(completions: Column) -> Column:
    """All completion texts, one per line; a missing text is an empty line."""
    return F.array_join(completions["content"], "\n", "")


def log_date(timestamp: Column) -> Column:
    """Date text before the `T`; NULL for no or empty text."""
    return F.when(timestamp != "", F.substring_index(timestamp, "T", 1))


def log_hour(timestamp: Column) -> Column:
    """Hour text between the first `T` and the next colon; NULL without a `T`."""
    rest = F.split_part(timestamp, F.lit("T"), F.lit(2))
    return F.when(timestamp.contains("T"), F.substring_index(rest, ":", 1))


def kst_hour(utc_hour: Column) -> Column:
    return F.pmod(utc_hour + F.lit(KST_OFFSET_HOURS), F.lit(24))


def hour_text(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def share(part: Column, whole: Column) -> Column:
    """Part of a whole as a double; 0 if the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return share(part, whole) * F.lit(100.0)
