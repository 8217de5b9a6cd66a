import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.functions.periods import Period
from tokentally.operators import activity, estimates, filters
from tokentally.plans import reports as whole
from datetime import date

COUNTERS = list(activity.MEASURES.values())


def reports(spark, *records):
    """Rows (user, date, {counter: value}); counters not given are NULL."""
    schema = "UserId string, Date string, " + ", ".join(f"{name} int" for name in COUNTERS)
    data = [(user, day, *[counters.get(name) for name in COUNTERS]) for user, day, counters in records]
    return spark.createDataFrame(data, schema)


def golden(spark):
    return reports(
        spark,
        ("u1", "10-01-2025", {
            "Chat_MessagesSent": 601, "Inline_SuggestionsCount": 536, "Inline_AcceptanceCount": 201,
            "Chat_AICodeLines": 2573, "Inline_AICodeLines": 201,
        }),
    )


def test_estimated_tokens_and_cost(spark):
    tokens = estimates.estimated_tokens(activity.totals(golden(spark)), "average")
    assert rows(tokens) == [("average", 122_310, 520_610, 642_920)]
    cost = estimates.virtual_cost(
        tokens, "estimated_input_tokens", "estimated_output_tokens", F.lit(15)
    ).collect()[0]
    assert cost["virtual_cost"] == pytest.approx(8.17608)
    assert cost["prorated_subscription"] == pytest.approx(9.5)
    assert cost["saving"] == pytest.approx(-1.32392)
    assert (cost["saving_percent"], cost["loss_percent"]) == pytest.approx((0.0, 13.936))


def test_unknown_scenario_is_average(spark):
    totals = activity.totals(golden(spark))
    assert rows(estimates.estimated_tokens(totals, "wild")) == rows(estimates.estimated_tokens(totals, "average"))


def test_no_days_and_no_tokens_do_not_divide_by_zero(spark):
    tokens = spark.createDataFrame([(0, 0)], "i bigint, o bigint")
    cost = estimates.virtual_cost(tokens, "i", "o", F.lit(0)).collect()[0]
    assert (cost["saving_percent"], cost["loss_percent"]) == (0.0, 0.0)


def test_empty_reports_give_zeros(spark):
    totals = activity.totals(reports(spark))
    assert rows(totals) == [(0,) * 9]
    assert rows(activity.trends(reports(spark))) == [(0.0, 0.0, 0.0, 0.0, 0, False)]
    assert {r["total_count"] for r in activity.by_feature(reports(spark)).collect()} == {0}


@pytest.mark.parametrize(
    ("used", "days", "projected", "status"),
    [(0, 15, 0, "ok"), (8, 15, 16, "caution"), (12, 15, 24, "warning"), (7, 14, 15, "ok"), (5, 0, 5, "ok")],
)
def test_limits(spark, used, days, projected, status):
    totals = spark.createDataFrame([(used,)], "total_dev_events bigint")
    dev, lines = estimates.official_limits(totals, days).collect()
    assert (dev["projected_monthly"], dev["status"]) == (projected, status)
    assert (lines["limit_name"], lines["used"], lines["status"]) == ("transformation_lines", 0, "ok")


def test_first_and_last_day_over_new_year(spark):
    frame = reports(
        spark,
        ("u", "12-31-2024", {"Chat_MessagesSent": 1}),
        ("u", "01-01-2025", {"Chat_MessagesSent": 2}),
        ("u", "01-01-2025", {"Chat_MessagesSent": 4}),
        ("idle", "01-01-2025", {}),
    )
    user, idle = activity.by_user(frame).collect()
    assert (user["user_id"], user["total_chat_messages"], user["active_days"]) == ("u", 7, 2)
    assert (user["first_activity"], user["last_activity"]) == ("12-31-2024", "01-01-2025")
    assert (user["first_activity_text"], user["last_activity_text"]) == ("01-01-2025", "12-31-2024")
    assert (idle["user_id"], idle["total_chat_messages"]) == ("idle", 0)
    assert [r["date_str"] for r in activity.by_date(frame).collect()] == ["12-31-2024", "01-01-2025"]


def test_bad_dates_are_left_out_and_ends_included(spark):
    days = ["12-31-2024", "01-01-2025", "01-02-2025", "2025-01-01", "", None]
    frame = reports(spark, *[("u", day, {}) for day in days])
    kept = filters.in_report_days(frame, date(2024, 12, 31), date(2025, 1, 1))
    assert sorted(r["Date"] for r in kept.collect()) == ["01-01-2025", "12-31-2024"]


def test_user_patterns(spark):
    frame = reports(spark, *[(user, "01-01-2025", {}) for user in ("a_b", "axb", "A_B", "a\\b", "100%")])

    def users(pattern):
        return sorted(r["UserId"] for r in filters.by_user(frame, pattern).collect())

    assert users("a_b") == ["a\\b", "a_b", "axb"]
    assert users("\\") == ["a\\b"]
    assert users("0%") == ["100%"]
    assert users("' OR 1=1 --") == []
    assert len(users("")) == len(users(None)) == 5


def test_spike(spark):
    quiet = [("u", f"01-{day:02d}-2025", {"Chat_MessagesSent": 10}) for day in range(1, 10)]
    loud = ("u", "01-10-2025", {"Chat_MessagesSent": 90, "Inline_SuggestionsCount": 60})
    spikes = activity.daily_spikes(reports(spark, *quiet, loud)).where("is_spike")
    assert rows(spikes.select("date_str", "activity", "threshold")) == [("01-10-2025", 150, 72.0)]
    found = activity.trends(reports(spark, *quiet, loud)).collect()[0]
    assert (found["daily_max"], found["daily_min"], found["anomaly_count"]) == (150.0, 10.0, 1)
    # Exactly three times the mean is no spike.
    edge = reports(spark, *[("u", f"01-0{d}-2025", {"Chat_MessagesSent": n}) for d, n in ((1, 0), (2, 0), (3, 9))])
    assert rows(activity.trends(edge).select("anomaly_detected")) == [(False,)]


def test_features_count_users_in_range_and_users_of_the_feature(spark):
    frame = reports(
        spark,
        ("a", "01-01-2025", {"Chat_MessagesSent": 2}),
        ("a", "01-02-2025", {"Chat_MessagesSent": 1}),
        ("b", "01-01-2025", {"Dev_GenerationEventCount": 5}),
        (None, "01-01-2025", {"Dev_GenerationEventCount": 1}),
    )
    found = {r[0]: tuple(r)[1:] for r in activity.by_feature(frame).collect()}
    assert found["Chat Messages"] == (3, 2, 1)
    assert found["/dev Events"] == (6, 2, 1)
    assert found["/doc Events"] == (0, 2, 0)


def test_month_projection(spark):
    used = spark.createDataFrame([(601,)], "chat bigint")
    row = estimates.month_projection(used, "chat", 15).collect()[0]
    assert (round(row["per_day"], 1), row["projected_month"]) == (40.1, 1202.0)


def test_report_equals_single_tables(spark):
    frame = reports(
        spark,
        ("a", "01-01-2025", {"Chat_MessagesSent": 2, "Transformation_LinesIngested": 100}),
        ("a", "01-01-2025", {"Chat_MessagesSent": 5}),
        ("b", "01-02-2025", {"DocGeneration_EventCount": 5}),
        ("b", "02-02-2025", {"DocGeneration_EventCount": 5}),
    )
    period = Period(date(2025, 1, 1), date(2025, 1, 31))
    wanted = filters.in_report_days(frame, period.start, period.end)
    with whole.activity_report(frame, period) as tables:
        assert rows(tables["user"]) == rows(activity.by_user(wanted))
        assert rows(tables["daily"]) == rows(activity.by_date(wanted))
        assert rows(tables["feature"]) == rows(activity.by_feature(wanted))
        assert rows(tables["trends"]) == rows(activity.trends(wanted))
        limits = {r["limit_name"]: r["used"] for r in tables["limit_check"].collect()}
        assert limits == {"dev_events": 0, "transformation_lines": 100}
        assert tables["cost"].count() == tables["tokens"].count() == 3
        assert tables["summary"].collect()[0]["total_doc_events"] == 5
