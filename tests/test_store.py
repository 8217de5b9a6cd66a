import pytest
from plain import rows
from pyspark.sql import functions as F

from tokentally.sources.store import BATCH, Manifest, Run, Store, due, newest, summed
from tokentally.streaming import jobs

SCHEMA = "k string, v long"


@pytest.fixture
def frame(spark):
    return lambda *data: spark.createDataFrame(data, SCHEMA)


def store(spark, folder, merge=None, fan=2):
    schema = spark.createDataFrame([], SCHEMA).schema
    return Store(spark, str(folder), schema, merge or newest(["k"]), fan)


def contents(store):
    return sorted(rows(store.read()), key=str)


def test_newest_row_of_each_key_over_many_batches(spark, frame, tmp_path):
    table = store(spark, tmp_path / "t")
    expected = {}
    for n in range(13):
        data = [(f"k{n % 5}", n), (None, -n), (f"once{n}", n)]
        expected |= dict(data)
        assert table.add(frame(*data), n)
        assert len(table.manifest().runs) <= 4  # levels of 13 batches by twos
    assert contents(table) == sorted(expected.items(), key=str)
    folders = list((tmp_path / "t").glob("batch=*"))
    assert len(folders) <= 8 and len(list((tmp_path / "t/_manifest").glob("*.json"))) == 2


def test_runs_stay_few_after_thousands_of_batches():
    """The rule alone, without files: eight runs of a level become one of the next."""
    runs, most, rewritten = [], 0, 0
    for n in range(5000):
        runs.append(Run(f"r{n}", 0, n, n))
        while some := due(runs):
            assert [r.first for r in some[1:]] == [r.last + 1 for r in some[:-1]]
            rewritten += some[-1].last - some[0].first + 1
            runs = [r for r in runs if r not in some] + [Run("m", some[0].level + 1, some[0].first, some[-1].last)]
            runs.sort(key=lambda r: r.first)
        most = max(most, len(runs))
    assert most <= 35 and rewritten <= 5 * 5000


def test_a_repeated_batch_changes_nothing(spark, frame, tmp_path):
    table = store(spark, tmp_path)
    assert table.add(frame(("a", 1)), 0) and table.add(frame(("a", 2)), 1)
    before = table.manifest()
    assert not table.add(frame(("a", 99)), 1) and not table.add(frame(("a", 98)), 0)
    assert table.manifest() == before and contents(table) == [("a", 2)]


def test_a_cut_batch_changes_nothing_and_is_removed(spark, frame, tmp_path):
    table = store(spark, tmp_path, fan=100)
    table.add(frame(("a", 1)), 0)
    table._write(frame(("a", 50)).withColumn(BATCH, F.lit(1).cast("long")), 0, 1, 1)  # never named
    (tmp_path / "_manifest/.draft").write_text("{")
    assert contents(table) == [("a", 1)]
    assert table.add(frame(("b", 2)), 1)
    assert contents(table) == [("a", 1), ("b", 2)] and len(list(tmp_path.glob("batch=*"))) == 2


def test_a_merge_that_fails_leaves_the_batch(spark, frame, tmp_path):
    def broken(rows):
        raise OSError("no space")

    good, bad = store(spark, tmp_path), store(spark, tmp_path, broken)
    good.add(frame(("a", 1)), 0)
    with pytest.raises(OSError):
        bad.add(frame(("a", 2)), 1)
    assert contents(good) == [("a", 2)]
    assert not good.add(frame(("a", 2)), 1)
    good.add(frame(("c", 3)), 2)  # merges what was due
    assert contents(good) == [("a", 2), ("c", 3)] and len(good.manifest().runs) == 1


def test_a_reader_of_the_manifest_before_still_finds_its_runs(spark, frame, tmp_path):
    table = store(spark, tmp_path, fan=3)
    for n in range(2):
        table.add(frame((f"k{n}", n)), n)
    reading = table.read()
    table.add(frame(("k2", 2)), 2)  # merged into one run at once
    assert len(table.manifest().runs) == 1
    assert sorted(rows(table.read())) == [("k0", 0), ("k1", 1), ("k2", 2)]
    with_old = table._rows(table._load(table._versions()[0]).runs)
    assert with_old.count() == 3 and reading.columns == ["k", "v"]


def test_sums(spark, frame, tmp_path):
    table = store(spark, tmp_path, summed(["k"], ["v"]))
    for n in range(5):
        table.add(frame(("a", n), (None, 1)), n)
    assert contents(table) == [("a", 10), (None, 5)]


def test_replacing_keeps_one_run(spark, frame, tmp_path):
    table = store(spark, tmp_path)
    for n in range(3):
        table.add(frame((f"k{n}", n)), n, replacing=True)
    assert contents(table) == [("k2", 2)] and len(list(tmp_path.glob("batch=*"))) == 1


def test_two_writers_are_told_apart(spark, frame, tmp_path):
    table = store(spark, tmp_path)
    table.add(frame(("a", 1)), 7, writer="x")
    with pytest.raises(ValueError, match="another writer"):
        table.add(frame(("a", 1)), 0, writer="y")
    stale = table.manifest()
    table.add(frame(("b", 1)), 8, writer="x")
    with pytest.raises(RuntimeError, match="another writer"):
        table._switch(Manifest(stale.version + 1, 8, "x"))


def test_nothing_written_gives_no_rows(spark, tmp_path):
    assert store(spark, tmp_path / "nothing").read().collect() == []


def test_a_stream_merges_its_batches(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for n in range(11):
        data = spark.createDataFrame([(f"k{n % 3}", n)], SCHEMA)
        data.coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    totals = stream.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    for _ in range(2):  # the second run has nothing new
        jobs.write_stream(totals, target, str(tmp_path / "check"), "update", keys=["k"]).awaitTermination()
        found = jobs.read_result(spark, target, totals.schema, "update", ["k"])
        assert sorted(rows(found)) == [("k0", 18, 4), ("k1", 22, 4), ("k2", 15, 3)]
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 12
    other = jobs.write_stream(totals, target, str(tmp_path / "other"), "update", keys=["k"])
    with pytest.raises(Exception, match="another writer"):
        other.awaitTermination()
