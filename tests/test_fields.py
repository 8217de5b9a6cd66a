from datetime import date, datetime

import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.functions import fields
from tokentally.functions.periods import Period, day_directories, day_glob, resolve_period


def applied(spark, function, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v"))).collect()]


def test_identity_label_is_the_whole_match(spark):
    labels = applied(
        spark,
        fields.identity_label,
        [
            "arn:aws:sts::111111111111:assumed-role/AppA-Role/s1",
            "arn:aws:sts::111111111111:assumed-role/AppA-Role/s2",
            "arn:aws:iam::111111111111:user/dev1",
            "arn:aws:iam::111111111111:role/AppB-Role",
            "arn:aws:iam::111111111111:role/user-service",
            "arn:aws:sts::111111111111:assumed-role",
            None,
        ],
    )
    assert labels == [
        "assumed-role/AppA-Role", "assumed-role/AppA-Role", "user/dev1", "Unknown", None, None, "Unknown",
    ]


def test_model_name_and_price_key(spark):
    models = [
        "us.anthropic.claude-3-haiku-20240307-v1:0",
        "arn:aws:models:us-east-1:1:inference-profile/us.anthropic.claude-sonnet-4-5-20250929-v1:0",
        "claude-3-haiku-20240307",
        "claude-3-haiku-v1",
        "vendor.other-model-v1-v2",
        "ends/with/",
        "a.b.",
        "",
        None,
    ]
    names = applied(spark, fields.model_name, models)
    assert names[:2] == [models[0], "us.anthropic.claude-sonnet-4-5-20250929-v1:0"]
    assert names[5:] == [None, "a.b.", None, None]

    def expected(model):
        return model.split(".")[-1].split("-v")[0] if "." in model else model

    keys = applied(spark, fields.price_key, models)
    assert keys == [None if m is None else expected(m) for m in models]


def test_text_tokens(spark):
    texts = ["", None, "ab", "abc", "가나다라마바", "😀😀😀", "x" * 100]
    assert applied(spark, fields.text_tokens, texts) == [0, 0, 0, 1, 2, 1, 33]


def test_joined_completions_keep_missing_texts_as_empty_lines(spark):
    values = [[("a",), (None,), ("b",)], [], None, [(None,)]]
    joined = applied(spark, fields.joined_completions, values, "array<struct<content:string>>")
    assert joined == ["a\n\nb", "", None, ""]


def test_log_date_and_hour(spark):
    texts = ["2024-01-05T07:08:09Z", "2024-01-05", "", None, "2024-01-05T", "T07"]
    assert applied(spark, fields.log_date, texts) == [
        "2024-01-05", "2024-01-05", None, None, "2024-01-05", "",
    ]
    assert applied(spark, fields.log_hour, texts) == ["07", None, None, None, "", "07"]


def test_broken_numbers_and_dates_do_not_stop_a_query(spark):
    assert applied(spark, fields.whole_number, ["12", "", None, "x", "-3"]) == [12, 0, 0, 0, -3]
    days = applied(spark, fields.report_day, ["12-31-2024", "2024-12-31", "", None, "02-30-2024"])
    assert days == [date(2024, 12, 31), None, None, None, None]


def test_kst_hours(spark):
    assert applied(spark, fields.kst_hour, [0, 14, 15, 23], "int") == [9, 23, 0, 8]


def test_partition_day_pads(spark):
    frame = spark.createDataFrame([("2024", "1", "5"), ("2024", "11", "25")], "year string, month string, day string")
    assert rows(frame.select(fields.partition_day())) == [(date(2024, 1, 5),), (date(2024, 11, 25),)]


def test_relative_period_has_one_day_more():
    now = datetime(2024, 3, 1, 13, 0)
    assert resolve_period(now, 7) == Period(date(2024, 2, 23), date(2024, 3, 1))
    assert resolve_period(now, 7).days == 8


def test_one_explicit_date_alone_is_ignored():
    now = datetime(2024, 3, 1)
    assert resolve_period(now, 2, start=date(2024, 1, 1)) == resolve_period(now, 2)
    assert resolve_period(now, 2, date(2024, 1, 1), date(2024, 1, 2)).days == 2


@pytest.mark.parametrize(
    ("start", "end", "expected"),
    [
        ((2024, 1, 30), (2024, 2, 1), ["2024/01/30", "2024/01/31", "2024/02/01"]),
        ((2024, 1, 31), (2024, 3, 1), ["2024/01/31", "2024/02/*", "2024/03/01"]),
        ((2022, 12, 31), (2024, 1, 1), ["2022/12/31", "2023/*/*", "2024/01/01"]),
        ((2024, 1, 2), (2024, 1, 1), []),
    ],
)
def test_day_directories(start, end, expected):
    assert day_directories(Period(date(*start), date(*end))) == expected


def test_day_glob_is_one_pattern():
    assert day_glob(Period(date(2024, 1, 30), date(2024, 1, 31))) == "{2024/01/30,2024/01/31}"
