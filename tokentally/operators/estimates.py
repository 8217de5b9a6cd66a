"""Figures derived from small totals: estimated tokens, limits, virtual cost, projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CAUTION_PERCENT,
    CONTEXT_WINDOW_TOKENS,
    DAYS_PER_MONTH,
    MONTHLY_DEV_EVENTS,
    MONTHLY_TRANSFORMED_LINES,
    SUBSCRIPTION_USD,
    TOKEN_ESTIMATES,
    VIRTUAL_PRICE,
    WARN_SHARE,
)
from ..functions import fields
from .activity import MEASURES


def _measure(df: DataFrame, name: str) -> Column:
    """A measure of the totals; 0 if it is not asked for there. An unknown name is an error."""
    if name not in MEASURES:
        raise ValueError(f"{name} is not a measure of activity reports")
    return fields.or_zero(F.col(name)) if name in df.columns else F.lit(0)


def _weighted(df: DataFrame, scenario: dict, weights: dict) -> Column:
    terms = [_measure(df, name) * F.lit(scenario[weight]) for name, weight in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total.cast("bigint")


_INPUT = {
    "total_chat_messages": "chat_in",
    "total_inline_suggestions": "inline_suggestion",
    "total_dev_events": "dev_in",
    "total_test_events": "test_in",
    "total_doc_events": "doc_in",
}
_OUTPUT = {
    "total_chat_messages": "chat_out",
    "total_chat_code_lines": "chat_code_line",
    "total_inline_code_lines": "inline_code_line",
    "total_inline_acceptances": "inline_suggestion",
    "total_dev_events": "dev_out",
    "total_test_events": "test_out",
    "total_doc_events": "doc_out",
}


def estimated_tokens(
    totals: DataFrame, scenario: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Estimated tokens of activity totals (or of users' totals), one row per scenario.

    One scenario may be asked for; an unknown one means `average`. `keep` names totals to carry along.
    """
    names = list(TOKEN_ESTIMATES)
    if scenario is not None:
        names = [scenario if scenario in TOKEN_ESTIMATES else "average"]
    rows = []
    for name in names:
        tokens_in = _weighted(totals, TOKEN_ESTIMATES[name], _INPUT)
        tokens_out = _weighted(totals, TOKEN_ESTIMATES[name], _OUTPUT)
        rows.append(
            F.struct(
                F.lit(name).alias("estimation_type"),
                tokens_in.alias("estimated_input_tokens"),
                tokens_out.alias("estimated_output_tokens"),
                (tokens_in + tokens_out).alias("estimated_total_tokens"),
            )
        )
    kept = [F.col("user_id")] if "user_id" in totals.columns else []
    return totals.select(*kept, *keep, F.inline(F.array(*rows)))


def official_limits(totals: DataFrame, days: int) -> DataFrame:
    """Use against the monthly limits, projected from a period of `days` days to 30."""
    factor = DAYS_PER_MONTH / days if days > 0 else 1.0

    def limit(name: str, measure: str, allowed: int) -> Column:
        used = _measure(totals, measure).cast("bigint")
        projected = (used * F.lit(factor)).cast("bigint")
        percentage = projected / F.lit(allowed) * F.lit(100.0)
        warning = projected >= F.lit(allowed * WARN_SHARE)
        status = (
            F.when(warning, "warning").when(percentage > CAUTION_PERCENT, "caution").otherwise("ok")
        )
        return F.struct(
            F.lit(name).alias("limit_name"),
            used.alias("used"),
            F.lit(allowed).cast("bigint").alias("monthly_limit"),
            projected.alias("projected_monthly"),
            percentage.alias("percentage"),
            warning.alias("warning"),
            status.alias("status"),
        )

    return totals.select(
        F.inline(
            F.array(
                limit("dev_events", "total_dev_events", MONTHLY_DEV_EVENTS),
                limit(
                    "transformation_lines", "total_transformation_lines", MONTHLY_TRANSFORMED_LINES
                ),
            )
        )
    )


def virtual_cost(
    df: DataFrame, input_column: str, output_column: str, days: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Cost of the tokens at the virtual price, against the subscription prorated to `days` days.

    The difference is a saving in percent of the cost if positive, else a loss in percent of the
    subscription. With no days the loss percentage is 0.
    """
    input_cost = fields.or_zero(F.col(input_column)) * F.lit(VIRTUAL_PRICE[0]) / F.lit(1000)
    output_cost = fields.or_zero(F.col(output_column)) * F.lit(VIRTUAL_PRICE[1]) / F.lit(1000)
    prorated = F.lit(SUBSCRIPTION_USD) * (days / F.lit(DAYS_PER_MONTH))
    costs = df.select(
        *keep,
        input_cost.alias("input_cost"),
        output_cost.alias("output_cost"),
        (input_cost + output_cost).alias("virtual_cost"),
        prorated.alias("prorated_subscription"),
    ).withColumn("saving", F.col("virtual_cost") - F.col("prorated_subscription"))
    saving = F.col("saving")
    return costs.withColumn(
        "saving_percent", F.when(saving > 0, fields.percent(saving, F.col("virtual_cost"))).otherwise(0.0)
    ).withColumn(
        "loss_percent",
        F.when(saving > 0, 0.0).otherwise(fields.percent(-saving, F.col("prorated_subscription"))),
    )


def context_use(df: DataFrame, tokens: str, days: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens as a percentage of one context window, in total and per day."""
    window = F.lit(CONTEXT_WINDOW_TOKENS)
    daily = F.col(tokens) / F.lit(days) if days > 0 else F.lit(0.0)
    return df.select(
        *keep,
        F.col(tokens),
        fields.percent(F.col(tokens), window).alias("usage_percent"),
        daily.alias("daily_average"),
        fields.percent(daily, window).alias("daily_percent"),
    )


def month_projection(df: DataFrame, measure: str, days: int) -> DataFrame:
    """Use of a period of `days` days, per day and carried on to 30 days."""
    per_day = F.col(measure) / F.lit(days)
    return df.select(
        F.col(measure),
        per_day.alias("per_day"),
        (per_day * F.lit(DAYS_PER_MONTH)).alias("projected_month"),
    )
