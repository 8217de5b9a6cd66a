import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentally.llm import nearest as nn


def brute(rows, every=20, count=20):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        scores = (vectors[k] * vectors).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[k]][:count]
        out[int(ids[k])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def recall(got, expected):
    pairs = [(len({v for v, _ in got.get(q, [])} & {v for v, _ in near}), len(near)) for q, near in expected.items()]
    return sum(a for a, _ in pairs) / sum(b for _, b in pairs)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, tables, scale):
    from tokentally.llm.catalogue import QUERIES

    folder = tables.replace("sf0.001", scale)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = brute(rows)
    got = answers(QUERIES["op4_nearest"](spark, folder))
    assert set(got) == set(expected)
    assert recall(got, expected) >= 0.93
    for q, near in got.items():
        vectors = {r[0]: np.array(r[1], dtype=np.float64) for r in rows}
        assert all(math.isclose(s, float((vectors[q] * vectors[v]).sum()), abs_tol=1e-12) for v, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_near_neighbours_take_few_visits(spark):
    """Tight clusters of different norms: almost all found, while few vectors are looked at."""
    chance = np.random.default_rng(3)
    centres = chance.standard_normal((200, 16))
    points = centres[chance.integers(0, 200, 6000)] + 0.05 * chance.standard_normal((6000, 16))
    points *= chance.uniform(0.95, 1.0, 6000)[:, None]
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    chosen = nn.plan(16, float(np.linalg.norm(points, axis=1).max()), 0.99, 6000, 20)
    buckets = chosen.buckets(points)
    sizes = np.unique(buckets[:, 0], return_counts=True)[1]
    assert (sizes.astype(float) ** 2).sum() < 0.2 * 6000**2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(answers(nn.nearest(df, every=100)), brute(rows, every=100)) >= 0.9


def test_isolated_vectors_among_clusters(spark):
    """The plan fits the clusters; queries outside them get their neighbours all the same."""
    chance = np.random.default_rng(7)
    centres = chance.standard_normal((60, 32))
    alone = chance.random(6000) < 0.15
    points = centres[chance.integers(0, 60, 6000)] + 0.02 * chance.standard_normal((6000, 32))
    points[alone] = chance.standard_normal((int(alone.sum()), 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, expected = answers(nn.nearest(df)), brute(rows)
    assert all(len(got.get(q, [])) == 20 for q in expected)
    for kind in (True, False):
        own = {q: near for q, near in expected.items() if alone[q] == kind}
        assert own and recall(got, own) >= 0.9


def test_visits_are_in_order_and_hold_their_share():
    chosen = nn.Plan(8, 1.0, 0.8, 5, 1.2, 2)
    chances = chosen.chances(np.random.default_rng(1).standard_normal((6, 8)))
    rows = chances.reshape(-1, 5, chosen.slots)
    code, visited = chosen.visits(rows, 0.7, 64)
    for own, codes, taken in zip(rows, code, visited):
        whole = own[0]
        for k in range(1, 5):
            whole = (own[k][:, None] * whole[None, :]).ravel()
        mine = whole[codes]
        assert (np.diff(mine) <= 1e-15).all() and np.isclose(mine[0], whole.max())
        assert mine[taken].sum() >= 0.7 > mine[taken][:-1].sum()


def test_hot_buckets_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_BYTES", 8 * 4 * 40)
    chance = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(0, 600, 2)] + [(k, chance.standard_normal(4).tolist()) for k in range(1, 200, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, expected = answers(nn.nearest(df)), brute(rows)
    assert got[20] == expected[20]  # equal vectors: the smallest ids
    assert recall(got, expected) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (2, [2.0, 1.0]), (40, None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = answers(nn.nearest(df))
    assert got == {0: [(2, 2.0), (1, 0.5), (20, -1.0)], 20: [(1, -0.5), (0, -1.0), (2, -2.0)]}
    assert nn.nearest(df.limit(0)).collect() == []
    assert nn.nearest(df.where(F.col("vec_id") == 3)).collect() == []
    assert nn.nearest(df.where(F.col("vec_id") == 0)).collect() == []
