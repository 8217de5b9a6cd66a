import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.operators import heaviest as h


def plain(df, k):
    sums = df.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("requests"))
    return rows(sums.orderBy(F.desc("w"), "a", "b").limit(k))


def skewed(spark):
    """Two keys have a third of all rows each, and 100,000 have one."""
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 3 == 1, -2).otherwise(F.col("id"))
    return spark.range(300_000).select(key.alias("a"), F.lit("x").alias("b"), (F.col("id") % 50).alias("w"))


def flat(spark):
    return spark.range(100_000).select((F.col("id") % 50_000).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1).cast("long").alias("w"))


@pytest.mark.parametrize("make", [skewed, flat])
@pytest.mark.parametrize("k", [1, 2, 7])
def test_equal_to_counting_every_key(spark, make, k):
    df = make(spark)
    assert rows(h.heaviest(df, ("a", "b"), "w", k, buckets=512)) == plain(df, k)


def test_few_keys_are_counted_on_skewed_data_and_all_on_flat(spark):
    def counted(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    assert "LeftSemi" in counted(h.heaviest(skewed(spark), ("a", "b"), "w", 2))
    assert "LeftSemi" not in counted(h.heaviest(flat(spark), ("a", "b"), "w", 2))


def test_a_heavy_key_in_a_light_looking_place(spark):
    """Every bucket order is right: the answer is in the third bucket, whose weight is one key's."""
    df = spark.createDataFrame([(k, "m", 10) for k in range(400)] + [(1000, "n", 60), (1001, "n", 55), (1002, "n", 50)], "a long, b string, w long")
    for buckets in (1, 2, 3, 16, 97):
        assert rows(h.heaviest(df, ("a", "b"), "w", 3, buckets, plain=1.0)) == plain(df, 3)


def test_ties_nulls_and_few_keys(spark):
    data = [(1, None, 5), (1, "a", 5), (None, None, 5), (2, "a", None), (3, "c", 0), (1, "a", None)]
    df = spark.createDataFrame(data, "a long, b string, w long")
    for k in (1, 3, 4, 5, 9):
        assert rows(h.heaviest(df, ("a", "b"), "w", k)) == plain(df, k)
    assert h.heaviest(df.limit(0), ("a", "b"), "w", 3).collect() == []
