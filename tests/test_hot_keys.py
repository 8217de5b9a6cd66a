"""One key with a third of all rows: results stay whole and equal a plain count in Python."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tokentally.operators import activity, invocations, prompts, tagged

MODEL = "us.anthropic.claude-3-haiku-20240307-v1:0"


@pytest.fixture(scope="module")
def records():
    chance = random.Random(11)
    return [
        (
            "hot" if n % 3 == 0 else f"t{chance.randint(1, 40)}",
            chance.randint(0, 50),
            chance.choice([None, *range(30)]),
        )
        for n in range(6000)
    ]


def calls(spark, records):
    frame = spark.createDataFrame(records, "key string, i int, o int").repartition(8)
    return frame.select(
        F.struct(F.col("key").alias("arn")).alias("identity"),
        F.lit(MODEL).alias("modelId"),
        F.lit("us-east-1").alias("region"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.lit("2024").alias("year"),
        F.lit("1").alias("month"),
        F.lit("1").alias("day"),
        F.struct(F.col("i").alias("inputTokenCount")).alias("input"),
        F.struct(F.col("o").alias("outputTokenCount")).alias("output"),
        F.create_map(
            F.lit("tenant_id"), F.col("key"), F.lit("application_name"), F.col("key")
        ).alias("requestMetadata"),
    )


def by_key(records):
    groups = defaultdict(list)
    for key, tokens_in, tokens_out in records:
        groups[key].append((tokens_in, tokens_out))
    return groups


def test_sums_per_identity_and_tenant(spark, records):
    frame = calls(spark, records)
    expected = {
        key: (len(rows), sum(i for i, _ in rows), sum(o or 0 for _, o in rows))
        for key, rows in by_key(records).items()
    }
    table = invocations.by_identity(invocations.as_cells(frame)).collect()
    assert {r["arn"]: (r["call_count"], r["total_input_tokens"], r["total_output_tokens"]) for r in table} == expected
    bills = tagged.chargeback(frame, "tenant_id").collect()
    assert {r["tenant_id"]: (r["requests"], r["total_input_tokens"], r["total_output_tokens"]) for r in bills} == expected


def test_exact_percentiles(spark, records):
    sizes = {key: [o for _, o in rows if o is not None] for key, rows in by_key(records).items()}
    for row in tagged.output_sizes(calls(spark, records)).collect():
        values = sizes[row["application_name"]]
        assert row["median_output"] == median(values)
        assert row["avg_output"] == pytest.approx(sum(values) / len(values))
        assert (row["min_output"], row["max_output"]) == (min(values), max(values))


def test_distinct_users_and_days(spark, records):
    schema = "UserId string, Date string, " + ", ".join(f"{c} int" for c in activity.MEASURES.values())
    days = [f"01-{i % 28 + 1:02d}-2024" for _, i, _ in records]
    rows = [(key, day, *[1] * len(activity.MEASURES)) for (key, _, _), day in zip(records, days, strict=True)]
    frame = spark.createDataFrame(rows, schema).repartition(8)
    total = activity.totals(frame).collect()[0]
    assert total["unique_users"] == len({key for key, *_ in records})
    assert total["active_days"] == len(set(days))
    assert total["total_chat_messages"] == len(records)
    users = {r["user_id"]: r["active_days"] for r in activity.by_user(frame).collect()}
    assert users["hot"] == len({day for (key, *_), day in zip(records, days, strict=True) if key == "hot"})


def test_prompt_breakdowns(spark, records):
    rows = [("chat", i, o or 0, "2024-01-01T00:00:00Z", key) for key, i, o in records]
    schema = "type string, input_tokens bigint, output_tokens bigint, timestamp string, user_id string"
    found = prompts.breakdowns(spark.createDataFrame(rows, schema).repartition(8)).collect()
    users = {r["user_id"]: r["requests"] for r in found if r["breakdown"] == "user"}
    assert users == {key: len(group) for key, group in by_key(records).items()}
    [total] = [r for r in found if r["breakdown"] == "total"]
    assert (total["requests"], total["input_tokens"]) == (6000, sum(i for _, i, _ in records))
