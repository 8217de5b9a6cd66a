"""What the plans of the registered queries must and must not hold."""

import pytest

from tokentally.operators import prompts
from tokentally.plans import views
from tokentally.plans.catalogue import QUERIES

BATCH = sorted(name for name in QUERIES if not name.endswith("_stream"))


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, tables, name):
    text = physical(QUERIES[name](spark, tables))
    for operator in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize(
    "name", ["agg_01_total_usage", "agg_02_usage_by_identity", "agg_04_usage_by_model", "agg_05_usage_by_day"]
)
def test_day_range_reaches_the_scan(spark, tables, name):
    text = physical(QUERIES[name](spark, tables))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in text
    assert "LessThan(ts,2024-02-01T00:00)" in text


def test_only_needed_columns_are_read(spark, tables):
    text = physical(QUERIES["agg_04_usage_by_model"](spark, tables))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>"


def test_usage_by_model_shuffles_once_before_the_sort(spark, tables):
    text = physical(QUERIES["agg_04_usage_by_model"](spark, tables))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("partial_sum") >= 1


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_breakdowns_read_once_and_multiply_reduced_rows_only(spark, tables, no_broadcast):
    text = physical(prompts.breakdowns(views.inline_prompts(spark, tables)))
    assert text.count("FileScan") == 1
    # From the scan upwards: reduced, shuffled, and only then multiplied by the grouping sets.
    assert "Expand" not in text.split("Exchange")[-1]


def test_activity_totals_multiply_sums_only(spark, tables, no_broadcast):
    text = physical(QUERIES["agg_07_activity_totals"](spark, tables))
    assert "Expand" not in text.split("Exchange")[-1]


@pytest.mark.parametrize("name", ["agg_24_usage_by_pattern", "joi_03_exact_cost_by_label"])
def test_identities_are_not_shuffled(spark, tables, name, no_broadcast):
    text = physical(QUERIES[name](spark, tables))
    keys = [line for line in text.split("\n") if "hashpartitioning" in line]
    assert keys and not any("arn#" in line for line in keys)


def test_virtual_cost_reads_the_reports_once(spark, tables, no_broadcast):
    text = physical(QUERIES["met_04_virtual_cost_active_days"](spark, tables))
    assert text.count("FileScan") == 1


def test_lags_of_an_hour_are_not_gathered(spark, tables, no_broadcast):
    text = physical(QUERIES["str_06_ingestion_lag_by_hour"](spark, tables))
    assert "percentile(" not in text


def test_raw_prompt_records_shuffle_nothing(spark, tables, no_broadcast):
    assert "Exchange" not in physical(QUERIES["src_05_prompt_records"](spark, tables))


def test_feature_table_reads_the_reports_once(spark, tables):
    text = physical(QUERIES["agg_10_usage_by_feature"](spark, tables))
    assert text.count("FileScan") == 1
    assert "Expand" not in text


def test_newest_requests_are_a_top_n(spark, tables):
    assert "TakeOrderedAndProject" in physical(QUERIES["prj_01_newest_requests"](spark, tables))


def test_no_text_is_shuffled_for_prompt_totals(spark, tables):
    text = physical(QUERIES["agg_20_prompt_totals"](spark, tables))
    assert "length(text" in text.split("Exchange")[-1]
