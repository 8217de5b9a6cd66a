import random
from decimal import Decimal

import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.constants import FALLBACK_PRICE, MODEL_PRICES, REGION_PRICES
from tokentally.operators import pricing

SCHEMA = "model_name string, total_input_tokens bigint, total_output_tokens bigint"


def usage(spark, *records):
    return spark.createDataFrame(list(records), SCHEMA)


def costs(df):
    return {r["model_name"]: r["estimated_cost_usd"] for r in df.collect()}


def test_known_cost(spark):
    df = usage(spark, ("us.anthropic.claude-3-7-sonnet-20250219-v1:0", 506, 4576))
    assert rows(pricing.with_cost(df).select("estimated_cost_usd")) == [(0.070158,)]


def test_sums_of_costs_do_not_depend_on_the_order(spark):
    """Costs from a millionth of a dollar to a billion, added up in different partitions."""
    chance = random.Random(3)
    records = [("claude-3-opus-20240229", chance.randrange(10**chance.randrange(1, 14)), k) for k in range(3000)]
    df = usage(spark, *records)
    sums = {
        pricing.with_cost(df.repartition(n), exact=True).agg(pricing.cost_sum()).first()[0] for n in (1, 3, 7, 16)
    }
    exact = sum(Decimal(i) * Decimal("0.015") + Decimal(o) * Decimal("0.075") for _, i, o in records) / 1000
    assert sums == {float(exact)} and exact > 10**9


def test_flat_costs(spark):
    df = usage(spark, ("a", 230, 510), ("b", 200, 450), ("c", 136, 250))
    found = costs(pricing.with_flat_cost(df))
    assert {k: round(v, 4) for k, v in found.items()} == {"a": 0.0007, "b": 0.0006, "c": 0.0003}


def test_unknown_missing_and_dotless_models(spark):
    df = usage(
        spark,
        ("vendor.other-model-v1", 1000, 1000),
        ("claude-3-opus-20240229", 1000, 1000),
        (None, 1000, 1000),
        ("", 1000, 1000),
        ("x.claude-3-haiku-20240307", None, 1000),
    )
    fallback = sum(FALLBACK_PRICE)
    expected = {
        "vendor.other-model-v1": fallback,
        "claude-3-opus-20240229": 0.09,
        None: fallback,
        "": fallback,
        "x.claude-3-haiku-20240307": FALLBACK_PRICE[1],
    }
    assert costs(pricing.with_cost(df)) == pytest.approx(expected)


def brute_force(model, listed):
    name = model or ""
    key = name.split(".")[-1].split("-v")[0] if "." in name else name
    for model_key, input_price, output_price in listed:
        if model_key in key:
            return input_price, output_price
    return FALLBACK_PRICE


def test_literal_and_table_prices_equal_brute_force(spark):
    chance = random.Random(7)
    keys = ["".join(chance.choice("ab-") for _ in range(chance.randint(1, 3))) for _ in range(12)]
    listed = {
        "default": tuple((key, float(i + 1), float(i + 101)) for i, key in enumerate(keys)),
        "north": tuple((key, float(i + 201), float(i + 301)) for i, key in enumerate(keys[::-1][:4])),
    }
    models = {"".join(chance.choice("ab.-v") for _ in range(chance.randint(0, 9))) for _ in range(300)}
    df = usage(spark, *[(model, 1000, 1_000_000) for model in [*models, None]])
    table = pricing.price_table(spark, listed)
    for region, used in (("default", "default"), ("north", "north"), ("nowhere", "default")):
        expected = {}
        for model in [*models, None]:
            unit = brute_force(model, listed[used])
            expected[model] = unit[0] + 1000 * unit[1]
        assert costs(pricing.with_cost(df, region=region, prices=listed)) == pytest.approx(expected)
        assert costs(pricing.with_table_cost(df, table, region=region)) == pytest.approx(expected)


def test_cost_by_row_region(spark):
    listed = {"default": (("m", 1.0, 0.0),), "north": (("m", 5.0, 0.0),)}
    df = usage(spark, ("m", 1000, 0)).withColumn("region", F.explode(F.array(F.lit("north"), F.lit("south"))))
    priced = pricing.with_cost_by_region(df, prices=listed)
    assert {r["region"]: r["estimated_cost_usd"] for r in priced.collect()} == {"north": 5.0, "south": 1.0}


def test_price_list_is_whole():
    assert len(MODEL_PRICES) == 11
    assert len(REGION_PRICES) == 7


def test_table_prices_do_not_multiply_rows_or_join_across(spark):
    df = usage(spark, ("claude-3-haiku-20240307 claude-3-opus-20240229", 1000, 0))
    priced = pricing.with_table_cost(df, pricing.price_table(spark))
    assert rows(priced.select("estimated_cost_usd")) == [(0.00025,)]
    text = priced._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text


def test_table_prices_keep_every_row(spark):
    rows_ = [(who, model, n, n) for n, who in enumerate("abc") for model in ("x.claude-3-opus-20240229", "other", None)]
    df = spark.createDataFrame(rows_ * 2, "who string, model_name string, total_input_tokens bigint, total_output_tokens bigint")
    priced = pricing.with_table_cost(df, pricing.price_table(spark))
    assert priced.columns == [*df.columns, "estimated_cost_usd"]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, priced.collect())) == sorted(map(key, pricing.with_cost(df).collect()))
    empty = pricing.with_table_cost(df, pricing.price_table(spark).limit(0))
    assert empty.count() == 18
