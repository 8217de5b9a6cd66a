import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally import schemas
from tokentally.plans import views
from tokentally.sources import invocations as logs


def scanned(df):
    """Rows that the scan has read to answer a query, and the answer."""
    answer = rows(df)
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        inner = node.children()
        for i in range(inner.size()):
            walk(inner.apply(i))

    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return sum(found), answer


@pytest.fixture(scope="module")
def table(spark, tables, tmp_path_factory):
    """40,000 calls of one day by 2,000 identities."""
    target = str(tmp_path_factory.mktemp("clustered") / "t")
    events = views.table(spark, tables, "events").limit(100).crossJoin(spark.range(400)).select(
        "id", "event_type", "value", "props", F.expr("event_id * 1000 + id").alias("event_id"), F.expr("(event_id * 1000 + id) % 10000").alias("user_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, (event_id * 1000 + id) * 7919 % 86400)").alias("ts"),
    )
    calls = views.invocations_of(events)
    logs.compact_clustered(calls.repartition(8), target, row_group_bytes=20_000)
    return logs.read_compacted(spark, target, schemas.TAGGED_INVOCATION), calls


def test_same_rows(table):
    stored, calls = table
    names = ("requestId", "identity.arn", "timestamp", "year", "month", "day")
    assert sorted(rows(stored.select(*names))) == sorted(rows(calls.select(*names)))


def test_row_groups_of_other_identities_are_skipped(table):
    stored, calls = table
    arn = calls.where("identity.arn LIKE '%user/dev%'").select("identity.arn").orderBy("arn").first()[0]
    read, answer = scanned(stored.where(F.col("identity.arn") == arn).select("requestId"))
    assert sorted(answer) == sorted(rows(calls.where(F.col("identity.arn") == arn).select("requestId")))
    assert answer and read < 0.35 * 40_000


def test_row_groups_without_the_request_are_skipped(table):
    stored, calls = table
    request = calls.select("requestId").orderBy("requestId").first()[0]
    read, answer = scanned(stored.where(F.col("requestId") == request).select("requestId", "timestamp"))
    assert len(answer) == 1 and read < 0.1 * 40_000


def test_row_groups_of_other_times_are_skipped(table):
    stored, _ = table
    hour = F.col("timestamp").between("2024-01-05T06:00:00Z", "2024-01-05T06:59:59Z")
    read, answer = scanned(stored.where(hour).select("requestId"))
    assert 0 < len(answer) <= read < 0.4 * 40_000


def test_a_day_may_be_written_again(spark, table, tmp_path):
    _, calls = table
    some = calls.limit(50)
    for _ in range(2):
        logs.compact_clustered(some, str(tmp_path / "t"))
    assert logs.read_compacted(spark, str(tmp_path / "t"), schemas.TAGGED_INVOCATION).count() == 50
