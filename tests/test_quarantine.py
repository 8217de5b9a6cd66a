import gzip
import json
from datetime import date

import pytest
from plain import rows

from tokentally.functions.periods import Period
from tokentally.sources import quarantine as q
from tokentally.sources.invocations import read_invocations

DAY = Period(date(2024, 1, 2), date(2024, 1, 2))


def call(n):
    return json.dumps({"modelId": f"m{n}", "input": {"inputTokenCount": n}, "output": {"outputTokenCount": 1}, "other": "x" * 200})


@pytest.fixture
def day(tmp_path):
    folder = tmp_path / "log/2024/01/02"
    folder.mkdir(parents=True)
    return folder


def names(df):
    return sorted((r[0].rsplit("/", 1)[-1], *r[1:]) for r in map(tuple, df.collect()))


def test_broken_lines_are_set_aside(spark, day):
    wrong_type = json.dumps({"modelId": "m9", "input": {"inputTokenCount": "many"}})
    (day / "a.json").write_text("\n".join([call(1), "{not json", call(2), wrong_type, call(3)]))
    (day / "b.json").write_text("\n".join([call(4), call(5)[:40]]))  # the file ends within a record
    (day / "c.json").write_text(call(6))
    (day / "empty.json").write_text("")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):  # strict stays the default
        read_invocations(spark, str(day.parents[2])).collect()
    found = q.sort_invocations(spark, str(day.parents[2]), DAY)
    assert sorted(r.modelId for r in found.records.collect()) == ["m1", "m2", "m3", "m4", "m6"]
    assert names(found.broken) == sorted([("a.json", "{not json"), ("a.json", wrong_type), ("b.json", call(5)[:40])])
    assert names(found.files) == [("a.json", 3, 2, "whole"), ("b.json", 1, 1, "whole"), ("c.json", 1, 0, "whole")]
    assert found.records.columns[-3:] == ["year", "month", "day"]
    assert rows(found.records.select("year", "month", "day").distinct()) == [("2024", "01", "02")]


def test_cut_and_false_gzip_files(spark, day):
    lines = "\n".join(call(n) for n in range(20_000)).encode()
    packed = gzip.compress(lines)
    (day / "cut.json.gz").write_bytes(packed[: len(packed) // 2])
    (day / "whole.json.gz").write_bytes(gzip.compress((call(30_000) + "\n").encode()) + gzip.compress(call(30_001).encode()))
    (day / "false.json.gz").write_bytes(b"this is no gzip")
    (day / "none.json.gz").write_bytes(b"")
    (day / "plain.json").write_text(call(40_000))
    found = q.sort_invocations(spark, str(day.parents[2]), DAY)
    files = {r[0]: r[1:] for r in names(found.files)}
    assert files["whole.json.gz"] == (2, 0, "whole") and files["plain.json"] == (1, 0, "whole")
    assert files["false.json.gz"] == (0, 0, "no gzip") and "none.json.gz" not in files  # empty files have nothing
    good, broken, state = files["cut.json.gz"]
    assert state == "cut" and 5_000 < good < 15_000 and broken <= 1
    ids = {int(r.modelId[1:]) for r in found.records.collect()}
    assert ids == {*range(good), 30_000, 30_001, 40_000}


def test_a_gzip_state_does_not_depend_on_sizes():
    for size in (0, 1, 1000, 3 << 20):
        packed = gzip.compress(b"x" * size)
        assert q._state(packed) == "whole" and q._state(packed + packed) == "whole"
        assert q._state(packed[:-1]) == "cut" and q._state(packed + packed[:-9]) == "cut"
    assert q._state(b"") == "cut" and q._state(b"abc") == "no gzip"


def test_log_events(spark, tmp_path):
    event = {"timestamp": 1, "message": {"modelId": "m"}, "ingestionTime": 5}
    (tmp_path / "good.json").write_text(json.dumps({"events": [event, event]}, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({"events": [event]}, indent=1)[:-9])
    found = q.sort_log_events(spark, str(tmp_path))
    assert [r.modelId for r in found.records.collect()] == ["m", "m"]
    assert [r[0] for r in names(found.broken)] == ["bad.json"]
    assert names(found.files) == [("bad.json", 0, 1, "whole"), ("good.json", 1, 0, "whole")]


def test_no_directory_gives_nothing(spark, tmp_path):
    found = q.sort_tagged_invocations(spark, str(tmp_path), DAY)
    assert found.records.collect() == found.broken.collect() == found.files.collect() == []
    assert found.records.columns[-3:] == ["year", "month", "day"]
    with pytest.raises(FileNotFoundError):
        q.sort_log_events(spark, str(tmp_path / "none"))
