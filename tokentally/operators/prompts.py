"""Prompt logs: flat rows with token counts, and breakdowns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields

COLUMNS = (
    "type", "input_tokens", "output_tokens", "timestamp", "user_id", "conversation_id", "file_name",
)


def flatten_records(logs: DataFrame, count_tokens=fields.text_tokens, *keep: str) -> DataFrame:
    """One row per chat or inline record of the `records` arrays; other records are dropped.

    `count_tokens` maps a text column to its token count. Only the counts leave the scan, so no
    text is shuffled later. `keep` names columns of `logs` to carry along, such as the file.
    """
    # The outer form adds no filter on the whole array; records of no kind are dropped below.
    record = logs.select(*keep, F.explode_outer("records").alias("r"))
    chat = F.col("r.generateAssistantResponseEventRequest")
    reply = F.col("r.generateAssistantResponseEventResponse")
    inline = F.col("r.generateCompletionsEventRequest")
    completions = F.col("r.generateCompletionsEventResponse.completions")
    empty = F.lit("")

    def text(value: Column) -> Column:
        return F.coalesce(value, empty)

    is_chat = chat.isNotNull()
    context = F.concat(text(inline["leftContext"]), text(inline["rightContext"]))
    prompt = F.when(is_chat, text(chat["prompt"])).otherwise(context)
    answer = F.when(is_chat, text(reply["assistantResponse"])).otherwise(
        text(fields.joined_completions(completions))
    )
    return record.where(is_chat | inline.isNotNull()).select(
        *keep,
        F.when(is_chat, "chat").otherwise("inline").alias("type"),
        count_tokens(prompt).alias("input_tokens"),
        count_tokens(answer).alias("output_tokens"),
        F.when(is_chat, chat["timeStamp"]).otherwise(inline["timeStamp"]).alias("timestamp"),
        F.when(is_chat, chat["userId"]).otherwise(inline["userId"]).alias("user_id"),
        F.when(is_chat, reply["messageMetadata"]["conversationId"]).alias("conversation_id"),
        F.when(~is_chat, inline["fileName"]).alias("file_name"),
    )


def both_kinds(chat: DataFrame, inline: DataFrame) -> DataFrame:
    """Chat and inline rows in one frame; a column only one side has is NULL on the other."""
    return chat.unionByName(inline, allowMissingColumns=True).select(*COLUMNS)


def prompt_cube(prompts: DataFrame) -> DataFrame:
    """Requests and tokens at the finest grain the breakdowns need; they take it in place of the rows."""
    return prompts.groupBy(
        "type",
        "user_id",
        fields.log_date(F.col("timestamp")).alias("date"),
        fields.log_hour(F.col("timestamp")).alias("hour"),
    ).agg(*_sums(prompts))


def _requests(df: DataFrame) -> Column:
    """The requests that a row stands for: those of a cube's cell, or one."""
    return F.col("requests") if "requests" in df.columns else F.lit(1).cast("bigint")


def _date(df: DataFrame) -> Column:
    return F.col("date") if "date" in df.columns else fields.log_date(F.col("timestamp"))


def _hour(df: DataFrame) -> Column:
    return F.col("hour") if "hour" in df.columns else fields.log_hour(F.col("timestamp"))


def _sums(df: DataFrame) -> list[Column]:
    return [
        fields.or_zero(F.sum(_requests(df))).alias("requests"),
        fields.or_zero(F.sum("input_tokens")).alias("input_tokens"),
        fields.or_zero(F.sum("output_tokens")).alias("output_tokens"),
    ]


def breakdowns(prompts: DataFrame) -> DataFrame:
    """Requests and tokens in total, by type, user, date and hour: one pass over the log.

    `breakdown` names the grouping. A NULL user is a group of its own. Rows without a date are not
    in the date breakdown, rows without an hour not in the hour breakdown. The hour breakdown
    counts requests only, so its tokens are NULL. Dates and hours are the log's, no zone shift.
    """
    keys = ["type", "user_id", "date", "hour"]
    # The grouping sets multiply rows by five, so the log is reduced first.
    cube = prompts if "requests" in prompts.columns else prompt_cube(prompts)
    # grouping_id sets one bit per key that is not grouped by: type is 8, user 4, date 2, hour 1.
    names = {"total": 15, "type": 7, "user": 11, "date": 13, "hour": 14}
    grouped = cube.groupingSets(
        [[F.col("type")], [F.col("user_id")], [F.col("date")], [F.col("hour")], []],
        *[F.col(key) for key in keys],
    ).agg(F.grouping_id().alias("gid"), *_sums(cube))
    label = F.lit(None)
    for name, gid in names.items():
        label = F.when(F.col("gid") == gid, name).otherwise(label)
    is_hour = F.col("breakdown") == "hour"
    return (
        grouped.withColumn("breakdown", label)
        .where((F.col("breakdown") != "date") | F.col("date").isNotNull())
        .where(~is_hour | F.col("hour").isNotNull())
        .select(
            "breakdown",
            *keys,
            "requests",
            F.when(~is_hour, F.col("input_tokens")).alias("input_tokens"),
            F.when(~is_hour, F.col("output_tokens")).alias("output_tokens"),
        )
    )


def totals(prompts: DataFrame) -> DataFrame:
    """One row: requests and tokens; zeros if there is no record."""
    return prompts.agg(*_sums(prompts)).withColumn(
        "total_tokens", F.col("input_tokens") + F.col("output_tokens")
    )


def by_type(prompts: DataFrame) -> DataFrame:
    """Count, share and per-request averages of chat and inline; a kind without requests has zeros."""
    kinds = []
    for kind in ("chat", "inline"):
        of_kind = F.col("type") == kind
        count = fields.or_zero(F.sum(F.when(of_kind, _requests(prompts))))
        tokens_in = fields.or_zero(F.sum(F.when(of_kind, F.col("input_tokens"))))
        tokens_out = fields.or_zero(F.sum(F.when(of_kind, F.col("output_tokens"))))
        kinds.append(
            F.struct(
                F.lit(kind).alias("type"),
                count.alias("requests"),
                tokens_in.alias("input_tokens"),
                tokens_out.alias("output_tokens"),
                fields.percent(count, F.sum(_requests(prompts))).alias("percent"),
            )
        )
    rows = prompts.agg(F.array(*kinds).alias("rows")).select(F.inline("rows"))
    both = F.col("input_tokens") + F.col("output_tokens")
    return (
        rows.withColumn("avg_input", fields.share(F.col("input_tokens"), F.col("requests")))
        .withColumn("avg_output", fields.share(F.col("output_tokens"), F.col("requests")))
        .withColumn("avg_total", fields.share(both, F.col("requests")))
        .orderBy("type")
    )


def by_user(prompts: DataFrame) -> DataFrame:
    """Requests and tokens per user, most tokens first."""
    return (
        prompts.groupBy("user_id")
        .agg(*_sums(prompts))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .orderBy(F.desc("total_tokens"), "user_id")
    )


def by_date(prompts: DataFrame) -> DataFrame:
    """Requests and tokens per date of the log, in order; rows without a date are left out."""
    dated = prompts.withColumn("date", _date(prompts))
    return (
        dated.where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(*_sums(prompts))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .orderBy("date")
    )


def top_users(prompts: DataFrame, n: int = 3) -> DataFrame:
    """The `n` heaviest users with their rank; the rank window sees only those `n` rows."""
    top = by_user(prompts).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("total_tokens"), "user_id"))
    return top.withColumn("rank", rank.cast("bigint"))


def by_conversation(prompts: DataFrame) -> DataFrame:
    """Requests and tokens per chat conversation."""
    return (
        prompts.where(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id")
        .agg(*_sums(prompts))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def hours_in_kst(prompts: DataFrame) -> DataFrame:
    """Requests per hour of day, with the hour in UTC and in Korean time, in UTC order."""
    utc = _hour(prompts).try_cast("int")
    hours = prompts.select(utc.alias("hour"), _requests(prompts).alias("requests"))
    return (
        hours.where(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.sum("requests").alias("requests"))
        .select(
            fields.hour_text(F.col("hour")).alias("utc_hour"),
            fields.hour_text(fields.kst_hour(F.col("hour"))).alias("kst_hour"),
            "requests",
        )
        .orderBy("utc_hour")
    )


def peak_hour(prompts: DataFrame) -> DataFrame:
    """The hour of day with the most requests; the earliest of equals."""
    return hours_in_kst(prompts).orderBy(F.desc("requests"), "utc_hour").limit(1)
