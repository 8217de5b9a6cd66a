import json
import os
import shutil
import time
from pathlib import Path

import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.plans import views
from tokentally.sources import invocations as logs
from tokentally.sources.shared import shared_folder, short_lived_tables, written
from tokentally.streaming import jobs, trends

SCHEMA = """timestamp string, input struct<inputTokenCount: int>, output struct<outputTokenCount: int>,
  requestMetadata map<string, string>"""


def write_batch(spark, folder, *records):
    data = [(at, (i,), (o,), {"application_name": app}) for at, app, i, o in records]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def stream(spark, folder, delay):
    source = spark.readStream.schema(SCHEMA).json(str(folder))
    return trends.with_event_time(source, delay)


def run(df, base, mode="append", keys=()):
    query = jobs.write_stream(df, str(base / "out"), str(base / "checkpoint"), mode)
    query.awaitTermination()
    return jobs.read_result(df.sparkSession, str(base / "out"), df.schema, mode, keys)


def test_windows_close_once_and_late_records_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 1), ("2024-01-01T00:20:00Z", "a", 2, 2), ("2024-01-01T03:00:00Z", "a", 5, 5))
    table = run(trends.usage_trend(stream(spark, source, "1 hour")), tmp_path)
    assert rows(table.select("total_tokens", "requests")) == [(6, 2)]
    # The first hour is closed: a record for it comes too late. The third is still open.
    write_batch(spark, source, ("2024-01-01T00:30:00Z", "a", 100, 100), ("2024-01-01T03:10:00Z", "a", 1, 1), ("2024-01-01T09:00:00Z", "a", 9, 9))
    table = run(trends.usage_trend(stream(spark, source, "1 hour")), tmp_path)
    assert sorted(rows(table.select("total_tokens", "requests"))) == [(6, 2), (12, 2)]


def test_alarm(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(
        spark, source,
        ("2024-01-01T00:10:00Z", "a", 5000, 5000), ("2024-01-01T00:20:00Z", "b", 5000, 5001),
        ("2024-01-01T00:30:00Z", "b", None, 9999), ("2024-01-01T05:00:00Z", "z", 0, 0),
    )
    table = run(trends.token_alarms(stream(spark, source, "10 minutes")), tmp_path)
    assert rows(table.select("application_name", "total_tokens")) == [("b", 10001)]


def test_running_totals_are_refreshed(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 1), ("2024-01-01T00:10:00Z", "b", 1, 1))
    totals = trends.running_totals(stream(spark, source, None))
    assert sorted(rows(run(totals, tmp_path, "complete"))) == [("a", 2, 1), ("b", 2, 1)]
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 10, 10))
    assert sorted(rows(run(totals, tmp_path, "complete"))) == [("a", 22, 2), ("b", 2, 1)]


def test_update_mode_keeps_all_keys(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 1), ("2024-01-01T00:10:00Z", "b", 1, 1))
    totals = trends.running_totals(stream(spark, source, None))
    run(totals, tmp_path, "update", ["application_name"])
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 10, 10), ("2024-01-01T00:10:00Z", None, 1, 0))
    found = run(totals, tmp_path, "update", ["application_name"])
    assert sorted(rows(found), key=str) == [("a", 22, 2), ("b", 2, 1), (None, 1, 1)]


def test_update_mode_survives_a_last_batch_without_rows(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 1), ("2024-01-01T05:00:00Z", "b", 1, 1))
    trend = trends.usage_trend(stream(spark, source, "10 minutes"))
    keys = ["window_start", "window_end", "application_name"]
    for _ in range(2):  # the second run has nothing new
        found = run(trend, tmp_path, "update", keys)
        assert sorted(rows(found.select("application_name", "total_tokens"))) == [("a", 2), ("b", 2)]


def test_complete_mode_keeps_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    for n in (1, 2, 3):
        write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 0))
        totals = trends.running_totals(stream(spark, source, None))
        assert rows(run(totals, tmp_path, "complete")) == [("a", n, n)]
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1


def test_old_files_count(spark, tmp_path):
    """A file far older than the newest one, seen in a later run."""
    folder = tmp_path / "log/2024/01/02"
    folder.mkdir(parents=True)

    def put(name, days_old):
        record = {"timestamp": "2024-01-02T05:00:00Z", "input": {"inputTokenCount": 1}, "output": {"outputTokenCount": 2}}
        (folder / name).write_text(json.dumps(record))
        then = time.time() - days_old * 86_400
        os.utime(folder / name, (then, then))

    calls = logs.stream_invocations(spark, str(tmp_path / "log"))
    put("new.json", 0)
    put("older.json", 1)
    per_day = calls.groupBy("year", "month", "day").count()
    assert rows(run(per_day, tmp_path, "complete")) == [("2024", "01", "02", 2)]
    put("restored.json", 400)
    assert rows(run(per_day, tmp_path, "complete")) == [("2024", "01", "02", 3)]


def test_run_available_into_a_folder_of_the_caller(spark, tmp_path):
    source = tmp_path / "in"
    write_batch(spark, source, ("2024-01-01T00:10:00Z", "a", 1, 1))
    totals = trends.running_totals(stream(spark, source, None))
    found = jobs.run_available(totals, "x", "complete", folder=str(tmp_path / "mine"))
    assert rows(found) == [("a", 2, 1)] and (tmp_path / "mine/table").is_dir()


def test_stream_over_several_files_equals_batch(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = views.table(spark, tables, "events")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
        [file] = Path(tmp_path / f"p{part}").glob("*.parquet")
        shutil.copy(file, source / f"events-{part}.parquet")
    calls = views.invocation_stream(spark, str(source))
    timed = trends.with_event_time(calls, trends.ARCHIVE_DELAY)
    streamed = run(trends.running_totals(timed), tmp_path, "complete")
    batch = trends.running_totals(trends.with_event_time(views.invocations(spark, tables)))
    assert sorted(rows(streamed), key=str) == sorted(rows(batch), key=str)


def test_stream_over_day_directories(spark, tmp_path):
    for day, app in (("2024/01/01", "a"), ("2024/01/01/05", "b"), ("2024/01/02", "a")):
        folder = tmp_path / "log" / day
        folder.mkdir(parents=True, exist_ok=True)
        at = f"{day[:10].replace('/', '-')}T05:00:00Z"
        record = {
            "timestamp": at, "input": {"inputTokenCount": 1}, "output": {"outputTokenCount": 2},
            "requestMetadata": {"application_name": app},
        }
        (folder / "x.json").write_text(json.dumps(record))
    calls = logs.stream_invocations(spark, str(tmp_path / "log"), files_per_batch=1)
    per_day = calls.groupBy("year", "month", "day").count()
    assert sorted(rows(run(per_day, tmp_path, "complete"))) == [("2024", "01", "01", 2), ("2024", "01", "02", 1)]


def test_shared_folder_is_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = (shared_folder(spark, "x") for _ in range(2))
    assert first.startswith(root + "/x-")
    assert first != second


def test_short_lived_tables_go_and_kept_ones_stay(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    with short_lived_tables(spark):
        written(spark.range(3), "gone")
        kept = written(spark.range(4), "stays", kept=True)
        assert len(list(root.glob("gone-*"))) == 1
    assert not list(root.glob("gone-*")) and kept.count() == 4
    assert written(spark.range(2), "later").count() == 2


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, _, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "x")
