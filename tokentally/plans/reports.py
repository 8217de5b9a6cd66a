"""Whole reports: all analyses of one log from one pass over it."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_REGION
from ..functions.periods import Period
from ..operators import activity, estimates, filters, invocations, prompts


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a reduced frame for the block. What a lost executor held is computed again."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def invocation_report(
    calls: DataFrame, period: Period, arn_pattern: str | None = None, region: str = DEFAULT_REGION
) -> Iterator[dict[str, DataFrame]]:
    """Summary, identity, identity and model, model, day and hour tables of a period.

    Two reduced frames serve all six: models by region, day and hour, which are few, and sums per
    identity and model, which may be as many as there are sessions and so carry no day or hour. Use
    the frames inside the block.
    """
    wanted = filters.by_arn(filters.in_days(calls, period.start, period.end), arn_pattern)
    cells = invocations.as_cells(wanted)
    identities = invocations.identity_sums(cells)
    with _kept(invocations.usage_cube(cells)) as cube, _kept(identities) as per_identity:
        yield {
            "summary": invocations.totals(cube, region),
            "user": invocations.by_identity(per_identity),
            "user_app": invocations.by_identity_model(per_identity, region),
            "model": invocations.by_model(cube, region),
            "daily": invocations.by_day(cube),
            "hourly": invocations.by_hour(cube),
        }


@contextmanager
def activity_report(
    reports: DataFrame, period: Period, user_pattern: str | None = None
) -> Iterator[dict[str, DataFrame]]:
    """Summary, users, days, features, token estimates, limits, trends and cost comparison.

    The files are parsed once; of their 46 columns, the 11 in use are kept.
    """
    wanted = filters.by_user(
        filters.in_report_days(reports, period.start, period.end), user_pattern
    )
    with _kept(wanted.select("UserId", "Date", *activity.MEASURES.values())) as rows:
        summary = activity.totals(rows, "total_doc_events", "total_transformation_lines")
        tokens = estimates.estimated_tokens(summary)
        yield {
            "summary": summary,
            "user": activity.by_user(rows),
            "daily": activity.by_date(rows),
            "feature": activity.by_feature(rows),
            "tokens": tokens,
            "limit_check": estimates.official_limits(summary, period.days),
            "trends": activity.trends(rows),
            "cost": estimates.virtual_cost(
                tokens,
                "estimated_input_tokens",
                "estimated_output_tokens",
                F.lit(period.days),
                keep=("estimation_type",),
            ),
        }


@contextmanager
def prompt_report(
    rows: DataFrame, period: Period, user_text: str | None = None
) -> Iterator[dict[str, DataFrame]]:
    """Breakdowns, kinds, users, dates, hours, context use and cost comparison of prompt rows.

    `rows` are flat rows with token counts. What is kept is their cube: one row for each type, user,
    date and hour.
    """
    with _kept(prompts.prompt_cube(filters.by_prompt_user(rows, user_text))) as kept:
        total = prompts.totals(kept)
        yield {
            "breakdowns": prompts.breakdowns(kept),
            "summary": total,
            "by_type": prompts.by_type(kept),
            "by_user": prompts.by_user(kept),
            "by_date": prompts.by_date(kept),
            "by_hour": prompts.hours_in_kst(kept),
            "context": estimates.context_use(total, "total_tokens", period.days),
            "cost": estimates.virtual_cost(
                total, "input_tokens", "output_tokens", F.lit(period.days)
            ),
        }
