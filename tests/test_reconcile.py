import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.operators import pricing, reconcile

SCHEMA = "model string, invocations bigint, input_tokens bigint, output_tokens bigint"
METRICS = [("3 haiku", 70, 2550, 13977), ("3.7 sonnet", 23, 506, 4576), ("sonnet 4.5", 52, 1828, 10400), ("opus 4", 25, 420, 2800)]
LOG = [("3 haiku", 60, 2130, 11977), ("3.7 sonnet", 23, 506, 4576), ("sonnet 4.5", 45, 1528, 9000), ("opus 4", 25, 420, 2800)]


def test_sources_of_one_day(spark):
    compared = reconcile.compare_sources(spark.createDataFrame(METRICS, SCHEMA), spark.createDataFrame(LOG, SCHEMA))
    found = {r["model"]: r for r in compared.collect()}
    assert {m for m, r in found.items() if r["matches"]} == {"3.7 sonnet", "opus 4"}
    haiku = found["3 haiku"]
    assert (haiku["diff_invocations"], haiku["diff_input_tokens"], haiku["diff_output_tokens"]) == (-10, -420, -2000)
    rates = {r["measure"]: r for r in reconcile.match_rates(compared).collect()}
    calls, tokens_in, tokens_out = (rates[m] for m in ("invocations", "input_tokens", "output_tokens"))
    assert [(r["metric_total"], r["log_total"]) for r in (calls, tokens_in, tokens_out)] == [(170, 153), (5304, 4584), (31753, 28353)]
    assert [round(r["match_percent"], 1) for r in (calls, tokens_in, tokens_out)] == [90.0, 86.4, 89.3]
    assert [round(r["difference_percent"], 1) for r in (calls, tokens_in, tokens_out)] == [11.1, 15.7, 12.0]


def test_models_on_one_side_and_without_name(spark):
    metrics = spark.createDataFrame([("a", 1, 1, 1), (None, 2, 2, 2)], SCHEMA)
    log = spark.createDataFrame([("b", 1, 1, 1), (None, 1, 1, 1), (None, 1, 1, 1)], SCHEMA)
    found = rows(reconcile.compare_sources(metrics, log).select("model", "metric_invocations", "log_invocations", "matches"))
    assert found == [(None, 2, 2, True), ("a", 1, 0, False), ("b", 0, 1, False)]


def test_metric_points_of_idle_models_are_left_out(spark):
    points = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 5, 5), ("idle", 0, 0, 0)], SCHEMA)
    assert rows(reconcile.metric_totals(points)) == [("a", 3, 10, 10)]


def test_billed_cost_of_one_model_agrees(spark):
    billed = spark.createDataFrame(
        [("3.7 sonnet", 0.001518), ("3.7 sonnet", 0.06864), ("3 haiku", 0.000639), ("3 haiku", 0.017484)],
        "model string, cost double",
    )
    keys = {"3.7 sonnet": "claude-3-7-sonnet-20250219", "3 haiku": "claude-3-haiku-20240307", "opus 4": "claude-opus-4-20250514"}
    sums = spark.createDataFrame(
        [(m, keys[m], i, o) for m, _, i, o in LOG if m in keys],
        "model string, model_name string, total_input_tokens bigint, total_output_tokens bigint",
    )
    computed = pricing.with_cost(sums).select("model", F.col("estimated_cost_usd").alias("cost"))
    found = {r["model"]: r for r in reconcile.compare_costs(billed, computed).collect()}
    assert {m: r["matches"] for m, r in found.items()} == {"3.7 sonnet": True, "3 haiku": False, "opus 4": False}
    assert found["3.7 sonnet"]["computed_cost"] == pytest.approx(0.070158)
    assert found["3 haiku"]["computed_cost"] == pytest.approx(0.01550375)
    assert found["opus 4"]["billed_cost"] is None


def test_bill_total_does_not_depend_on_row_order(spark):
    costs = [0.1] * 1000 + [1e9, -1e9, 0.000001]
    frame = spark.createDataFrame([("x", c) for c in costs], "usage_type string, cost double")
    total = rows(reconcile.bill_by_usage_type(frame.repartition(7)).where("is_total").select("usage_type", "cost"))
    assert total == [(None, 100.000001)]
