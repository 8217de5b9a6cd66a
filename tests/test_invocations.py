from datetime import UTC, date, datetime

import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.functions.periods import Period
from tokentally.operators import filters, invocations, prompts, tagged
from tokentally.plans import reports, views
from tokentally.streaming import trends

SCHEMA = """timestamp string, region string, requestId string, modelId string,
  identity struct<arn: string>, input struct<inputTokenCount: int>,
  output struct<outputTokenCount: int>, requestMetadata map<string, string>,
  year string, month string, day string"""


def calls(spark, *records):
    """Rows of (arn, model, in, out, day of January 2024, metadata)."""
    data = [
        (f"2024-01-{day:02d}T10:00:00Z", "us-east-1", f"r{n}", model, (arn,), (i,), (o,), meta, "2024", "1", str(day))
        for n, (arn, model, i, o, day, meta) in enumerate(records)
    ]
    return spark.createDataFrame(data, SCHEMA)


ROLE = "arn:aws:sts::1:assumed-role/App-Role/"
HAIKU = "us.anthropic.claude-3-haiku-20240307-v1:0"


def test_sessions_of_a_role_stay_apart_but_share_a_label(spark):
    frame = calls(spark, (ROLE + "s1", HAIKU, 1, 1, 1, {}), (ROLE + "s2", HAIKU, 1, 1, 1, {}), (ROLE + "s2", HAIKU, 1, 1, 1, {}))
    cells = invocations.as_cells(frame)
    assert rows(invocations.by_identity(cells).select("user_or_app", "call_count")) == [
        ("assumed-role/App-Role", 2), ("assumed-role/App-Role", 1),
    ]
    assert rows(invocations.by_label(cells).select("user_or_app", "call_count")) == [("assumed-role/App-Role", 3)]


def test_calls_without_tokens_count_as_calls(spark):
    frame = calls(spark, ("a", HAIKU, None, 5, 1, {}), ("a", HAIKU, 4, None, 1, {}), ("a", HAIKU, None, 7, 1, {}))
    row = invocations.by_model(invocations.as_cells(frame)).collect()[0]
    assert (row["call_count"], row["avg_input_tokens"], row["avg_output_tokens"]) == (3, 4.0, 6.0)
    empty = calls(spark, ("a", HAIKU, None, None, 1, {}))
    row = invocations.by_model(invocations.as_cells(empty)).collect()[0]
    assert (row["total_input_tokens"], row["avg_input_tokens"], row["estimated_cost_usd"]) == (0, None, 0.0)


def test_days_in_order_not_text_order(spark):
    frame = calls(spark, *[("a", HAIKU, 1, 1, day, {}) for day in (10, 9, 2)])
    days = [r["day"] for r in invocations.by_day(invocations.as_cells(frame)).collect()]
    assert days == ["2", "9", "10"]
    kept = filters.in_days(frame, date(2024, 1, 2), date(2024, 1, 9))
    assert sorted(r["day"] for r in kept.collect()) == ["2", "9"]


def test_patterns_nobody_matches_are_rows_of_zeros(spark):
    frame = calls(spark, (ROLE + "s1", HAIKU, 1000, 0, 1, {}))
    found = invocations.by_pattern(invocations.as_cells(frame), ["App", "Role", "Other"])
    assert rows(found) == [("App", 1, 1000, 0, 0.00025), ("Other", 0, 0, 0, 0.0), ("Role", 1, 1000, 0, 0.00025)]
    nothing = invocations.by_pattern(invocations.as_cells(calls(spark)), ["App"])
    assert rows(nothing) == [("App", 0, 0, 0, 0.0)]


def test_orders_are_those_of_the_reports(spark, tables):
    cells = invocations.as_cells(views.invocations(spark, tables))
    counts = [r["call_count"] for r in invocations.by_identity(cells).collect()]
    assert counts == sorted(counts, reverse=True)
    pairs = [(r["user_or_app"] or "", -r["call_count"]) for r in invocations.by_identity_model(cells).collect()]
    assert pairs == sorted(pairs)
    hours = [(int(r["month"]), int(r["day"]), r["hour"]) for r in invocations.by_hour(cells).collect()]
    assert hours == sorted(hours)


def test_report_from_the_cube_equals_tables_from_the_log(spark, tables):
    calls_frame = views.invocations(spark, tables)
    period = Period(date(2024, 1, 5), date(2024, 1, 20))
    wanted = filters.by_arn(filters.in_days(calls_frame, period.start, period.end), "Role")
    cells = invocations.as_cells(wanted)
    with reports.invocation_report(calls_frame, period, "Role") as report:
        assert rows(report["summary"].drop("total_cost_usd")) == rows(invocations.totals(cells).drop("total_cost_usd"))
        for name, table in (
            ("user", invocations.by_identity(cells)),
            ("user_app", invocations.by_identity_model(cells)),
            ("model", invocations.by_model(cells)),
            ("daily", invocations.by_day(cells)),
            ("hourly", invocations.by_hour(cells)),
        ):
            assert rows(report[name]) == rows(table), name


def test_prompt_report(spark, tables):
    with reports.prompt_report(views.prompts(spark, tables), Period(date(2024, 1, 1), date(2024, 1, 30))) as report:
        total = report["summary"].collect()[0]
        assert total["total_tokens"] == total["input_tokens"] + total["output_tokens"]
        kinds = report["by_type"].collect()
        assert [k["type"] for k in kinds] == ["chat", "inline"]
        assert sum(k["requests"] for k in kinds) == total["requests"]
        raw = views.prompts(spark, tables)
        for name, table in (
            ("summary", prompts.totals(raw)), ("by_type", prompts.by_type(raw)), ("by_user", prompts.by_user(raw)),
            ("by_date", prompts.by_date(raw)), ("by_hour", prompts.hours_in_kst(raw)),
        ):
            assert sorted(rows(report[name]), key=str) == sorted(rows(table), key=str), name
        assert sorted(rows(report["breakdowns"]), key=str) == sorted(rows(prompts.breakdowns(raw)), key=str)


def test_event_time_bounds_are_half_open_and_zoned(spark):
    frame = calls(spark, *[("a", HAIKU, 1, 1, day, {}) for day in (1, 2, 3)])
    first, before = datetime(2024, 1, 1, 10, tzinfo=UTC), datetime(2024, 1, 3, 10, tzinfo=UTC)
    assert filters.in_event_time(frame, first, before).count() == 2


def test_heavy_filters_drop_unknown_tokens(spark):
    meta = {"environment": "production", "application_name": "X"}
    frame = calls(spark, ("a", HAIKU, 60, 41, 1, meta), ("a", HAIKU, 60, 40, 1, meta), ("a", HAIKU, None, 999, 1, meta))
    assert filters.heavy_requests(frame, "production", "X", 100).count() == 1
    assert filters.large_requests(frame, 900).count() == 1


def test_percentiles_of_a_hot_application(spark):
    frame = calls(spark, *[("a", HAIKU, 1, n, 1, {"application_name": "hot"}) for n in [5] * 50 + [1, 2, 100]], ("a", HAIKU, 1, None, 1, {}))
    none, hot = tagged.output_sizes(frame).collect()
    assert tuple(none) == (None,) * 6
    assert (hot["min_output"], hot["median_output"], hot["max_output"]) == (1, 5.0, 100)


def test_prompt_breakdowns_keep_missing_users(spark):
    schema = "type string, input_tokens bigint, output_tokens bigint, timestamp string, user_id string"
    frame = spark.createDataFrame(
        [("chat", 1, 2, "2024-01-01T05:00:00Z", None), ("chat", 3, 4, "2024-01-01", "u"), ("inline", 5, 6, None, None)],
        schema,
    )
    found = {(r["breakdown"], r["type"] or r["user_id"] or r["date"] or r["hour"]): r for r in prompts.breakdowns(frame).collect()}
    assert set(found) == {
        ("total", None), ("type", "chat"), ("type", "inline"), ("user", None), ("user", "u"),
        ("date", "2024-01-01"), ("hour", "05"),
    }
    assert found["user", None]["requests"] == 2
    assert found["date", "2024-01-01"]["requests"] == 2
    assert (found["hour", "05"]["requests"], found["hour", "05"]["input_tokens"]) == (1, None)
    assert found["total", None]["output_tokens"] == 12


def test_prompt_user_filter(spark):
    frame = spark.createDataFrame([("Ann",), ("BANNER",), ("bob",), (None,), ("",)], "user_id string")
    kept = filters.by_prompt_user(frame, "aNN").collect()
    assert sorted(str(r[0]) for r in kept) == ["", "Ann", "BANNER", "None"]


def test_pattern_rows_repeat_and_stay_without_calls(spark):
    frame = calls(spark, (ROLE + "s1", HAIKU, 1000, 1000, 1, {}), (ROLE + "s2", None, 1, None, 1, {}))
    found = invocations.by_pattern(invocations.as_cells(frame), ["App", "s1", "s1", "Other"])
    got = [(r["pattern"], r["call_count"], r["total_input_tokens"], r["estimated_cost_usd"]) for r in found.collect()]
    assert got == [("App", 2, 1001, 0.00150025), ("Other", 0, 0, 0.0), ("s1", 1, 1000, 0.0015), ("s1", 1, 1000, 0.0015)]


@pytest.mark.parametrize("zone", ["Asia/Seoul", "Asia/Kolkata", "America/New_York"])
def test_hours_are_utc_in_any_session(spark, zone):
    frame = calls(spark, ("a", HAIKU, 1, 1, 1, {}))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cells = invocations.as_cells(frame)
        assert [r["hour"] for r in cells.collect()] == [10]
        assert invocations.peak_hour(cells).first()["hour"] == "10"
        events = frame.select(
            F.to_timestamp("timestamp").alias("event_time"),
            F.timestamp_seconds(F.unix_seconds(F.to_timestamp("timestamp")) + 90).alias("ingestion_time"),
        )
        hour = trends.lag_by_hour(events).select(F.unix_seconds("hour"), "median_lag").first()
        assert tuple(hour) == (int(datetime(2024, 1, 1, 10, tzinfo=UTC).timestamp()), 90.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
