import json
import os
import time
from datetime import date

import pytest
from plain import rows

from tokentally.functions.periods import Period
from tokentally.sources import ingest

YEAR = Period(date(2023, 12, 30), date(2024, 2, 2))


@pytest.fixture
def archive(spark, tmp_path):
    return ingest.Archive(spark, str(tmp_path / "log"), str(tmp_path / "table"))


def put(tmp_path, name, *tokens, days_old=0):
    path = tmp_path / "log" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"modelId": f"m{n}", "input": {"inputTokenCount": n}}) for n in tokens))
    then = time.time() - days_old * 86_400
    os.utime(path, (then, then))


def tokens(archive):
    return sorted(r.modelId for r in archive.read().collect())


def test_months_cover_the_period():
    pieces = list(ingest.months(YEAR))
    assert [(p.start, p.end) for p in pieces] == [
        (date(2023, 12, 30), date(2023, 12, 31)), (date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 2)),
    ]


def test_each_run_reads_new_files_only_of_any_age(archive, tmp_path, monkeypatch):
    opened = []
    archive.read_files = lambda spark, paths, schema: opened.extend(paths) or ingest.strict(spark, paths, schema)
    assert archive.ingest(YEAR) == 0 and archive.read().collect() == []
    put(tmp_path, "2024/01/05/a.json", 1, 2)
    put(tmp_path, "2024/02/01/10/b.json", 3)
    put(tmp_path, "2024/02/09/out.json", 99)  # not of the period
    assert archive.ingest(YEAR) == 2 and archive.ingest(YEAR) == 0
    put(tmp_path, "2023/12/31/restored.json", 4, days_old=4000)
    assert archive.ingest(YEAR) == 1
    assert tokens(archive) == ["m1", "m2", "m3", "m4"] and len(opened) == 3
    assert sorted(set(rows(archive.read().select("year", "month", "day")))) == [
        ("2023", "12", "31"), ("2024", "01", "05"), ("2024", "02", "01")
    ]
    assert archive.files().count() == 3


def test_batches_are_bounded(archive, tmp_path):
    for n in range(7):
        put(tmp_path, f"2024/01/{n + 1:02}/f.json", n)
    sizes = []
    archive.read_files = lambda spark, paths, schema: sizes.append(len(paths)) or ingest.strict(spark, paths, schema)
    assert archive.ingest(YEAR, files_per_batch=3) == 7
    assert sizes == [3, 3, 1] and tokens(archive) == [f"m{n}" for n in range(7)]


def test_a_run_that_ends_between_notes_and_rows_goes_on(archive, tmp_path):
    put(tmp_path, "2024/01/05/a.json", 1)

    def fails(spark, paths, schema):
        raise OSError("lost")

    works, archive.read_files = archive.read_files, fails
    with pytest.raises(OSError):
        archive.ingest(YEAR)
    assert archive.files().collect() == [] and archive.read().collect() == []
    put(tmp_path, "2024/01/06/b.json", 2)
    archive.read_files = works
    assert archive.ingest(YEAR) == 2 and tokens(archive) == ["m1", "m2"] and archive.ingest(YEAR) == 0


def test_a_run_that_ends_after_the_rows_reads_nothing_twice(archive, tmp_path, monkeypatch):
    put(tmp_path, "2024/01/05/a.json", 1)
    real = ingest.Store._clean

    def fails(store, kept):
        if store is archive._rows:
            raise OSError("lost")
        real(store, kept)

    monkeypatch.setattr(ingest.Store, "_clean", fails)
    with pytest.raises(OSError):
        archive.ingest(YEAR)
    monkeypatch.setattr(ingest.Store, "_clean", real)
    assert archive.ingest(YEAR) == 0 and tokens(archive) == ["m1"]


def test_a_changed_file_replaces_its_records(archive, tmp_path):
    put(tmp_path, "2024/01/05/a.json", 1, 2, days_old=3)
    put(tmp_path, "2024/01/05/b.json", 3)
    archive.ingest(YEAR)
    put(tmp_path, "2024/01/05/a.json", 1, 2, 5)
    assert archive.ingest(YEAR) == 1 and tokens(archive) == ["m1", "m2", "m3", "m5"]
    assert archive.files().count() == 2


def test_a_broken_record_stops_before_its_batch_counts(archive, tmp_path):
    put(tmp_path, "2024/01/05/a.json", 1)
    archive.ingest(YEAR)
    path = tmp_path / "log/2024/01/05/b.json"
    path.write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        archive.ingest(YEAR)
    assert tokens(archive) == ["m1"]
    path.unlink()  # the noted file is gone: the run says so instead of leaving it out
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        archive.ingest(YEAR)
