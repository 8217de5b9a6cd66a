import math
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tokentally.operators import tagged


def calls(spark, n):
    """Calls over two days, two thirds of them of one application, nearly all sizes distinct, some missing."""
    size = F.when(F.col("id") % 97 == 0, None).otherwise(((F.col("id") * 104729) % 1_000_003).cast("int"))
    name = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, "cold")
    return spark.range(n).select(
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 172_800), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(size.alias("outputTokenCount")).alias("output"),
        F.create_map(F.lit("application_name"), name).alias("requestMetadata"),
    )


def test_sizes_of_a_range_are_exact_for_many_calls(spark):
    frame = calls(spark, 300_000)
    first, before = datetime(2024, 1, 1, 5, tzinfo=UTC), datetime(2024, 1, 2, 7, tzinfo=UTC)
    seconds = F.unix_timestamp(F.to_timestamp("timestamp"))
    inside = frame.where((seconds >= int(first.timestamp())) & (seconds < int(before.timestamp())))
    sizes = {}
    for r in inside.select(F.col("requestMetadata")["application_name"].alias("a"), F.col("output.outputTokenCount").alias("s")).collect():
        sizes.setdefault(r.a, []).append(r.s)
    found = {r.application_name: r for r in tagged.sizes_between(frame, first, before).collect()}
    assert set(found) == {"hot", "cold", None}
    for name, values in sizes.items():
        present = sorted(v for v in values if v is not None)
        row = found[name]
        assert (row.min_output, row.max_output) == (present[0], present[-1])
        assert math.isclose(row.avg_output, sum(present) / len(present), rel_tol=1e-12)
        assert row.median_output == present[math.ceil(len(present) * 0.5) - 1]
        assert row.p95_output == present[math.ceil(len(present) * 0.95) - 1]


def test_an_application_without_sizes_gets_nulls(spark):
    frame = calls(spark, 10).withColumn("output", F.struct(F.lit(None).cast("int").alias("outputTokenCount")))
    rows = tagged.sizes_between(frame, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC)).collect()
    assert {r.application_name for r in rows} == {"hot", "cold", None}
    assert all(r.min_output is None and r.median_output is None and r.p95_output is None for r in rows)
