import random
from datetime import datetime, timedelta

import pytest
from plain import rows

from tokentally.sources.store import Store
from tokentally.streaming import jobs, late, trends

SCHEMA = """timestamp string, input struct<inputTokenCount: int>, output struct<outputTokenCount: int>,
  requestMetadata map<string, string>"""
START = datetime(2024, 1, 1)


def put(spark, folder, *records):
    data = [(f"{at:%Y-%m-%dT%H:%M:%SZ}" if at else None, (n,), (1,), {"application_name": app}) for at, app, n in records]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def stream(spark, folder):
    return trends.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)))


def run(spark, tmp_path, **options):
    late.write_windows(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), **options).awaitTermination()
    return late.read_windows(spark, str(tmp_path / "out"))


def simulated(batches, delay):
    """Sums by window and application, on time and late, and the watermark, by loops."""
    on_time, behind, mark = {}, {}, None
    for batch in batches:
        for at, app, n in batch:
            start = at.replace(minute=0, second=0)
            late_now = mark is not None and start + timedelta(hours=1) <= mark
            own = (behind if late_now else on_time).setdefault((start, app), [0, 0])
            own[0] += n + 1
            own[1] += 1
        newest = max(at for at, _, _ in batch) - delay
        mark = newest if mark is None else max(mark, newest)
    return on_time, behind, mark


def plain(df):
    return {(r.window_start.replace(tzinfo=None), r.application_name): [r.total_tokens, r.requests] for r in df.collect()}


def test_append_output_and_side_table_are_the_batch_twin(spark, tmp_path):
    """Hours of delay, several applications, null among them."""
    chance = random.Random(4)
    batches = []
    for n in range(6):
        moment = START + timedelta(hours=2 * n)
        batches.append(
            [
                (moment - timedelta(minutes=chance.choice([5, 20, 90, 200, 400])), chance.choice(["a", "b", None]), chance.randrange(50))
                for _ in range(40)
            ]
        )
        put(spark, tmp_path / "in", *batches[-1])
        found = run(spark, tmp_path, delay="1 hour")  # a run for each batch: the stream goes on where it was
    on_time, behind, mark = simulated(batches, timedelta(hours=1))
    assert behind and found.watermark == round((mark - datetime(1970, 1, 1)).total_seconds() * 1000)
    ended = {k: v for k, v in on_time.items() if k[0] + timedelta(hours=1) <= mark}
    assert plain(found.closed()) == ended
    assert plain(found.late()) == behind
    twin = trends.usage_trend(trends.with_event_time(spark.read.schema(SCHEMA).json(str(tmp_path / "in"))))
    twin = plain(twin)
    assert plain(found.all()) == twin
    assert plain(found.corrected()) == {k: v for k, v in twin.items() if k[0] + timedelta(hours=1) <= mark}


def test_closed_windows_are_those_of_append_mode(spark, tmp_path):
    hour = timedelta(hours=1)
    folder = tmp_path / "in"
    for n, offsets in enumerate([(0.1, 0.5), (1.2, 4.0), (0.3, 1.5, 4.1), (2.5, 9.0), (3.9, 0.2, 9.5), (20.0,)]):
        put(spark, folder, *((START + hour * o, "a", n) for o in offsets))
        found = run(spark, tmp_path, delay="1 hour")
        timed = trends.with_event_time(spark.readStream.schema(SCHEMA).json(str(folder)), "1 hour")
        trend = trends.usage_trend(timed)
        jobs.write_stream(trend, str(tmp_path / "append"), str(tmp_path / "append_check")).awaitTermination()
        spark_gave = plain(jobs.read_result(spark, str(tmp_path / "append"), trend.schema))
        assert plain(found.closed()) == spark_gave
    assert plain(found.late())


def test_records_without_time_and_empty_batches(spark, tmp_path):
    put(spark, tmp_path / "in", (None, "a", 1))
    assert run(spark, tmp_path).watermark is None
    put(spark, tmp_path / "in", (START, "a", 1))
    found = run(spark, tmp_path, every="1 hour")
    assert plain(found.all()) == {(START, "a"): [2, 1]} and plain(found.closed()) == {}
    assert run(spark, tmp_path).rows.count() == 1  # nothing new


def test_a_batch_that_fails_before_it_counts_is_added_once(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", (START, "a", 1))
    real = Store._switch

    def fails(store, new):
        raise OSError("lost")

    monkeypatch.setattr(Store, "_switch", fails)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path)
    monkeypatch.setattr(Store, "_switch", real)
    assert plain(run(spark, tmp_path).all()) == {(START, "a"): [2, 1]}


def test_nothing_written(spark, tmp_path):
    found = late.read_windows(spark, str(tmp_path / "none"))
    assert rows(found.all()) == rows(found.closed()) == rows(found.late()) == rows(found.corrected()) == []
