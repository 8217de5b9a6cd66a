import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentally.llm import cover_tree, hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives=3, least=50, most=95):
    """By sorting all products, row by row, with Python's integers."""
    rows = [
        (k, label, [int(np.floor(256 * float(np.float32(c)))) for c in v])
        for k, v, label in rows
        if k is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for k, label, v in rows:
        if not anchor(k):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in rows if j != k)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and -least * score <= -100 * s[0] <= -most * score]
            out += [(k, j, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def points(kind, count, width, seed=0):
    chance = np.random.default_rng(seed)
    labels = chance.integers(0, 4, count).tolist()
    if kind == "random":
        vectors = chance.standard_normal((count, width))
    elif kind == "clustered":
        centres = 3 * chance.standard_normal((12, width))
        vectors = centres[chance.integers(0, 12, count)] + 0.1 * chance.standard_normal((count, width))
        vectors *= chance.uniform(0.2, 2, count)[:, None]
    else:  # a third of all rows are copies, others are on a coarse grid, so products tie
        vectors = np.round(chance.standard_normal((count, width)))
        vectors[chance.uniform(size=count) < 0.33] = vectors[0]
    return [(k, v.astype(np.float32).tolist(), label) for k, (v, label) in enumerate(zip(vectors, labels, strict=True))]


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
@pytest.mark.parametrize("served", [1, 1000])
def test_equals_brute_force_over_many_pages(spark, monkeypatch, kind, served):
    monkeypatch.setattr(hn, "PAGE_ROWS", 64)
    monkeypatch.setattr(hn, "CELLS", 5)
    monkeypatch.setattr(hn, "SAMPLE", 64)
    monkeypatch.setattr(hn, "SERVED", served)
    rows = points(kind, 700, 6)
    assert found(spark, rows, 20) == brute(rows, lambda k: k % 20 == 0)


def test_query_equals_sql(same_as_sql):
    same_as_sql("op12_hard_negatives")


def test_other_numbers_of_partners(spark):
    rows = points("clustered", 300, 4, seed=3)
    options = {"positives": 2, "negatives": 7, "least": 0, "most": 99}
    assert found(spark, rows, 10, **options) == brute(rows, lambda k: k % 10 == 0, **options)


def test_trees_are_nets_and_cover(spark):
    """Levels are nested, every node covers what lies below it, and leaves are small parts of clusters."""
    chance = np.random.default_rng(5)
    vectors = (100 * chance.standard_normal((500, 8))).astype(np.int32)
    vectors[100:200] = vectors[7]
    labels, ids = chance.integers(0, 9, 500), np.arange(500)
    tree = cover_tree.Tree.of(vectors, labels, ids)
    units = cover_tree.directions(tree.vectors, tree.longest)
    assert sorted(tree.ids) == list(range(500)) and tree.leaves[-1] == 500
    above = set()
    for a, b in zip(tree.levels[:-1], tree.levels[1:]):
        centres = set(tree.centre[a:b].tolist())
        assert above <= centres
        above = centres
        assert tree.first[a] == 0 and tree.last[b - 1] == len(tree.leaves) - 1
        for j in range(a, b):
            part = slice(tree.leaves[tree.first[j]], tree.leaves[tree.last[j]])
            assert np.abs(cover_tree.angles(units[part] @ units[tree.centre[j]]).max() - tree.angle[j]) < 1e-7
            assert (tree.low[j], tree.high[j]) == (tree.labels[part].min(), tree.labels[part].max())
    again = cover_tree.Tree.unpacked(tree.packed(), 8)
    assert (again.vectors == tree.vectors).all() and (again.last == tree.last).all()


def test_most_of_clustered_data_is_not_looked_at(monkeypatch):
    chance = np.random.default_rng(6)
    centres = chance.standard_normal((40, 16))
    vectors = centres[chance.integers(0, 40, 4000)] + 0.02 * chance.standard_normal((4000, 16))
    vectors = np.floor(256 * vectors).astype(np.int32)
    tree = cover_tree.Tree.of(vectors, np.zeros(4000, np.int64), np.arange(4000))
    windows = cover_tree.Windows(
        vectors[:50], np.zeros(50, np.int64), np.arange(50), np.arange(50), np.full(50, hn.LOWEST), np.full(50, hn.HIGHEST)
    )
    seen = []
    real = cover_tree.compared
    monkeypatch.setattr(cover_tree, "compared", lambda w, some, l, rows, s: seen.append(len(some) * len(rows[0])) or real(w, some, l, rows, s))
    got = tree.search(windows, 5, True)
    scores = vectors[:50].astype(np.int64) @ vectors.T
    np.put_along_axis(scores, np.arange(50)[:, None], -(1 << 62), axis=1)
    order = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), -scores), axis=1)[:, :5]
    assert got.id.reshape(50, 5).tolist() == order.tolist()
    assert sum(seen) < 0.15 * 50 * 4000


def test_products_beyond_53_bits_are_exact():
    queries = np.array([[(1 << 22) - 1] * 8192], np.int32)
    vectors = queries.copy()
    vectors[0, 0] -= 1
    assert cover_tree.products(queries, vectors)[0, 0] == 8192 * ((1 << 22) - 1) ** 2 - (1 << 22) + 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2),
        (4, [0.0, 0.0], 1), (5, [-1.0, -2.0], 1), (6, [0.25, 1.0], 3), (10, [0.0, 0.0], 1), (20, [5.0, 5.0], 9), (30, [1.0, 0.0], -4),
        (None, [1.0, 2.0], 1), (40, [1.0, 2.0], None), (50, None, 1), (60, [], 1), (70, [nan, 1.0], 1), (80, [1.0, None], 2), (90, [inf, 1.0], 1),
    ]
    assert found(spark, rows, 10) == brute(rows, lambda k: k % 10 == 0)
    short = rows + [(7, [1.0], 2), (8, [1.0, 2.0, 3.0], 2)]
    assert found(spark, short, 10) == brute(rows, lambda k: k % 10 == 0)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", uid string, cell int")
    anchor = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, hn.hard_negatives(df, anchor).collect())) == brute(rows, lambda k: k % 10 == 0)
    empty = hn.hard_negatives(df.limit(0), anchor)
    assert empty.collect() == [] and empty.dtypes == hn.hard_negatives(df, anchor).dtypes
    assert hn.hard_negatives(df, F.lit(False)).collect() == []
    assert hn.hard_negatives(df.where("label = 1"), anchor).collect() == []
