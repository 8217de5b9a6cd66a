from datetime import date, datetime

import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.functions.periods import Period
from tokentally.operators import activity, sketches
from tokentally.plans import views


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def calls(spark):
    """A million calls, two thirds of them of one application, sizes far from even."""
    size = F.when(F.col("id") % 3 == 0, (F.col("id") * 7919) % 1000).otherwise(F.pow((F.col("id") * 104729) % 1013, F.lit(2.0)).cast("int"))
    return spark.range(1_000_000).select(
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 100_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(size.cast("int").alias("outputTokenCount")).alias("output"),
        F.create_map(F.lit("application_name"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold")).alias("requestMetadata"),
    )


def test_quantiles_are_within_the_stated_rank_error(spark, calls):
    hours = sketches.size_sketches(calls, k=512)
    assert hours.count() == 2 * 28
    first, before = datetime(2024, 1, 1, 3), datetime(2024, 1, 2)
    flat = calls.select(
        F.col("requestMetadata.application_name").alias("app"), F.col("output.outputTokenCount").alias("size"), F.to_timestamp("timestamp").alias("at")
    )
    flat = flat.where((F.col("at") >= F.lit(first)) & (F.col("at") < F.lit(before))).cache()
    for row in sketches.sizes_between(hours, first, before, k=512).collect():
        own = flat.where(F.col("app") == row.application_name)
        for value, rank in ((row.median_output, 0.5), (row.p95_output, 0.95)):
            n, below, upto = own.agg(
                F.count("*"), F.count_if(F.col("size") < value), F.count_if(F.col("size") <= value)
            ).first()
            assert below / n - sketches.rank_error(512) <= rank <= upto / n + sketches.rank_error(512)
        exact = own.agg(F.min("size"), F.max("size"), F.avg("size")).first()
        assert (row.min_output, row.max_output) == tuple(exact)[:2] and row.avg_output == pytest.approx(exact[2])


def test_stored_sketches_give_any_range_without_the_calls(spark, calls, tmp_path):
    sketches.size_sketches(calls).write.parquet(str(tmp_path / "hours"))
    stored = spark.read.parquet(str(tmp_path / "hours"))
    direct = sketches.sizes_between(sketches.size_sketches(calls), datetime(2024, 1, 1, 5))
    merged = sketches.sizes_between(stored, datetime(2024, 1, 1, 5))
    plan = physical(direct)  # before it has run, so that it is listed once
    assert plan.count("Range") == 1 and "percentile" not in plan
    assert [r[:4] for r in sorted(rows(direct))] == [r[:4] for r in sorted(rows(merged))]


def test_calls_without_sizes(spark):
    schema = "timestamp string, output struct<outputTokenCount: int>, requestMetadata map<string, string>"
    at = "2024-01-01T05:00:00Z"
    data = [(at, (None,), {"application_name": "a"}), (at, (7,), {}), ("2024-01-01T06:00:00Z", (None,), {})]
    found = sketches.sizes_between(sketches.size_sketches(spark.createDataFrame(data, schema)))
    assert sorted(rows(found), key=str) == sorted([("a", None, None, None, None, None), (None, 7, 7, 7.0, 7, 7)], key=str)
    assert sketches.sizes_between(sketches.size_sketches(spark.createDataFrame([], schema))).collect() == []


def reports(spark, days, users):
    """Each user on several days; one user in three has chats, one in four suggestions."""
    frame = spark.range(days * users).select(
        F.concat(F.lit("u"), F.col("id") % users).alias("UserId"),
        F.date_format(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") / users).cast("int")), "MM-dd-yyyy").alias("Date"),
        (F.col("id") % users % 3 == 0).cast("int").alias("Chat_MessagesSent"),
        (F.col("id") % users % 4 == 0).cast("int").alias("Inline_SuggestionsCount"),
    )
    others = [c for c in activity.MEASURES.values() if c not in frame.columns]
    return frame.select("*", *(F.lit(None).cast("int").alias(c) for c in others))


def test_many_users_are_counted_within_the_stated_error(spark, tmp_path):
    sketches.user_sketches(reports(spark, 5, 200_000)).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 5
    periods = [Period(date(2024, 1, 1), date(2024, 1, 5)), Period(date(2024, 1, 2), date(2024, 1, 2)), Period(date(2023, 1, 1), date(2023, 1, 9))]
    found = {(r.start, r.end): r.unique_users for r in sketches.users_between(days, periods).collect()}
    assert found[periods[2].start, periods[2].end] == 0
    for p in periods[:2]:
        assert found[p.start, p.end] == pytest.approx(200_000, rel=0.012)
    pairs = {(r[0], r[1]): r[2:] for r in sketches.shared_users(days, date(2024, 1, 1), date(2024, 1, 31)).collect()}
    a, b, both = pairs["Chat Messages", "Inline Suggestions"]
    assert a == pytest.approx(200_000 / 3, rel=0.03) and b == pytest.approx(50_000, rel=0.03)
    assert both == pytest.approx(200_000 / 12, rel=0.08)
    assert pairs["/dev Events", "/test Events"] == (0, 0, 0)


def test_few_users_are_counted_exactly(spark):
    days = sketches.user_sketches(reports(spark, 3, 1000))
    assert [r.unique_users for r in sketches.users_between(days, [Period(date(2024, 1, 1), date(2024, 1, 3))]).collect()] == [1000]
    assert sketches.users_between(days, []).collect() == []
    broken = reports(spark, 1, 5).withColumn("Date", F.lit("n/a"))
    assert sketches.user_sketches(broken).collect() == []


def test_one_pass_over_the_reports(spark, tables):
    text = physical(sketches.users_between(sketches.user_sketches(views.activity(spark, tables)), [Period(date(2024, 1, 1), date(2024, 1, 3))]))
    assert text.count("FileScan") == 1 and "Expand" not in text
