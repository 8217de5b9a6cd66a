from datetime import datetime, timedelta

import pytest
from plain import rows

from tokentally.streaming import jobs, reconcile

SCHEMA = "event_time timestamp, model string, invocations long, input_tokens long, output_tokens long"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def put(spark, folder, *points):
    data = [(at(hours), model, n, 10 * n, 100 * n) for hours, model, n in points]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def run(spark, tmp_path):
    def go(**delays):
        sides = [spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name)) for name in ("metrics", "log")]
        compared = reconcile.compare_by_hour(*sides, **delays)
        jobs.write_stream(compared, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return jobs.read_result(spark, str(tmp_path / "out"), compared.schema)

    return go


def flush(spark, tmp_path, run, *hours, **delays):
    """Points far ahead on both sides, so that the hours before are closed."""
    for hour in hours:
        for name in ("metrics", "log"):
            put(spark, tmp_path / name, (hour, "end", 1))
        found = run(**delays)
    return {(r.hour, r.model): r for r in found.collect() if r.model != "end"}


def test_both_sides_closed_equal_the_batch_twin(spark, tmp_path, run):
    put(spark, tmp_path / "metrics", (0.1, "a", 3), (0.5, "a", 2), (0.2, None, 1), (1.1, "b", 4), (2.5, "", 6), (2.6, "only metrics", 7))
    put(spark, tmp_path / "log", (0.3, "a", 1), (0.9, "a", 4), (0.2, None, 1), (1.1, "b", 3), (2.5, "", 6), (2.7, "only log", 8))
    run()
    found = flush(spark, tmp_path, run, 30, 60, 90)
    expected = {(0, "a"): (5, 5), (0, None): (1, 1), (1, "b"): (4, 3), (2, ""): (6, 6), (2, "only metrics"): (7, 0), (2, "only log"): (0, 8)}
    assert {k: (r.metric_invocations, r.log_invocations) for k, r in found.items()} == {(at(h), m): v for (h, m), v in expected.items()}
    assert {k for k, r in found.items() if r.matches} == {(at(0), "a"), (at(0), None), (at(2), "")}
    assert found[at(2), "only log"].diff_output_tokens == 800
    sides = [spark.read.schema(SCHEMA).parquet(str(tmp_path / name)) for name in ("metrics", "log")]
    batch = {(r.hour, r.model): tuple(r) for r in reconcile.compare_by_hour(*sides).collect() if r.model != "end"}
    assert {k: tuple(r) for k, r in found.items()} == batch


def test_an_hour_stays_open_until_the_slower_side_has_passed_it(spark, tmp_path, run):
    put(spark, tmp_path / "metrics", (0.1, "a", 3), (20, "end", 1))
    put(spark, tmp_path / "log", (0.2, "a", 1))
    assert rows(run()) == []
    put(spark, tmp_path / "log", (0.4, "a", 2))  # hours behind the metrics, but the log's own watermark is not
    assert rows(run()) == []
    found = flush(spark, tmp_path, run, 40, 70, 100)
    assert (found[at(0), "a"].metric_invocations, found[at(0), "a"].log_invocations) == (3, 3)


def test_points_behind_both_watermarks_are_not_counted(spark, tmp_path, run):
    put(spark, tmp_path / "metrics", (0.1, "a", 3))
    put(spark, tmp_path / "log", (0.2, "a", 3))
    flush(spark, tmp_path, run, 40, 70)
    put(spark, tmp_path / "log", (0.3, "a", 50))
    found = flush(spark, tmp_path, run, 100, 130)
    assert len(found) == 1 and found[at(0), "a"].matches
