import random

import pytest
from pyspark.sql import functions as F

from tokentally.llm import mixing
from tokentally.llm.mixing import mix_table, mixed, source_sizes, with_targets


def shared_out(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by handing out the excess again and again."""
    target = {s: 0.0 for s in sizes}
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    rest, free = share * sum(sizes.values()), set(sizes)
    while free and rest > 1e-9:
        whole = sum(weight[s] for s in free)
        level = {s: target[s] + rest * weight[s] / whole for s in free}
        rest = 0.0
        for s in sorted(free, key=str):
            target[s] = level[s]
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        free = {s for s in free if target[s] < most * sizes[s]}
    return target


def test_equals_sql(same_as_sql):
    same_as_sql("op8_mixing")


def test_targets_equal_repeated_sharing(spark):
    chance = random.Random(5)
    for n in (1, 2, 7, 40):
        sizes = {f"s{k}": int(chance.paretovariate(0.7) * 10) for k in range(n)} | {None: 5, "é": 0}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in with_targets(source_sizes(rows)).collect()}
        expected = shared_out(sizes)
        assert all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in sizes)


def test_taken_is_near_the_target_and_repeatable(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("source", F.lit("one"))
    more = docs.select(F.col("doc_id") + 10_000, F.lit("a b c d e f").alias("text"), "lang", F.lit("two"), "n_chars")
    both = docs.union(more.union(more).union(more))
    first, again = (sorted(map(tuple, mix_table(x).collect())) for x in (both, both.repartition(7)))
    assert first == again
    by_source = {}
    for _, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size
        total = by_source.setdefault((source_size, target), [0, 0])
        total[0] += taken
        total[1] = max(total[1], size)
    assert all(abs(taken - target) <= 2 * largest for (_, target), (taken, largest) in by_source.items())


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x", None), (4, "w " * 50_000, "b"), (4, "w", "b"), (4, "w", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = sorted(map(tuple, mix_table(docs).collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(1, 0), (2, 0), (3, 2), (4, 1), (4, 1), (4, 50_000), (None, 1)]
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in got)
    assert mix_table(docs.limit(0)).collect() == []
    emitted = mixed(docs)
    assert emitted.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in emitted.collect()) == sum(r[4] for r in got)


@pytest.mark.parametrize("identity", ["CAST(NULL AS LONG)", "id * 1000", "id"])
def test_null_and_spaced_ids_are_dealt_evenly(spark, monkeypatch, identity):
    """No group of documents that are ranked together is much larger than meant."""
    monkeypatch.setattr(mixing, "GROUP", 100)
    docs = spark.range(10_000).selectExpr(f"{identity} AS doc_id", "concat('a b c d ', id) AS text", "'s' AS source")
    groups = mixing._rows(docs).groupBy(F.col("spread") % 100).count()
    sizes = [r["count"] for r in groups.collect()]
    assert len(sizes) == 100 and max(sizes) < 160
    taken = [r.taken for r in mix_table(docs).collect()]
    assert len(taken) == 10_000 and abs(sum(taken) - 1.5 * 50_000) <= 100 * 5


def test_repeated_rows_are_mixed_as_often_as_drawn(spark):
    """Many equal rows, some with another column of their own; taken together as the table of draws says."""
    rows = [(k % 40, f"a b c {k % 20}", "one", k) for k in range(400)] + [(None, "x y", None, k) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(6)
    expected, got = {}, {}
    for r in mix_table(docs).collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    emitted = mixed(docs)
    assert emitted.columns == docs.columns
    for r in emitted.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {doc: n for doc, n in expected.items() if n}
