from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentally.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, components=32):
    """n, deviations (exact), and per component eigenvalue share and whitened values, up to the sign."""
    kept = [(k, v) for k, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    t = x * n - sums
    deviations = [int(d) for d in (t**2).sum(axis=1)]
    covariance = np.array([[float(Fraction(int((t[:, a] * t[:, b]).sum()), n**3)) for b in range(x.shape[1])] for a in range(x.shape[1])])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    z = (t / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
    return n, [k for k, _ in kept], deviations, values[order] / values.sum(), z


def check(df, rows, components=32):
    n, ids, deviations, shares, z = by_hand(rows, components)
    got = df.orderBy("vec_id", "component").collect()
    k = len(shares)
    assert [(r.vec_id, r.component) for r in got] == [(i, c + 1) for i in ids for c in range(k)]
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    assert [r.deviation for r in got[::k]] == deviations
    assert [r.explained for r in got[:k]] == pytest.approx(list(shares), rel=1e-9)
    own = np.array([r.whitened for r in got]).reshape(len(ids), k)
    signs = np.sign((own * z).sum(axis=0))
    assert np.abs(own * signs - z).max() < 1e-8


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_plain_whitening(spark, tables, scale):
    from tokentally.llm.catalogue import QUERIES

    folder = tables.replace("sf0.001", scale)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    check(QUERIES["op11_whitening"](spark, folder), rows)


def test_float32_alone_would_not_do(spark, tables):
    """The refinement is what makes the vectors exact."""
    vectors = spark.read.parquet(f"{tables}/embeddings.parquet").toPandas()["embedding"]
    x = wh.whole(np.stack(vectors).astype(float)).astype(float)
    covariance = np.cov(x.T, bias=True)

    def residual(q):
        q = q.astype(np.longdouble)
        image = q.T @ covariance.astype(np.longdouble) @ q
        return float(np.abs(image - np.diag(np.diag(image))).max()), float(np.abs(q.T @ q - np.eye(len(q))).max())

    rough = np.linalg.eigh(covariance.astype(np.float32))[1]
    values, exact = wh.eigen(covariance)
    assert residual(rough)[1] > 1e-8 and max(residual(exact)) < 1e-13
    assert np.all(np.diff(values) <= 0)


@pytest.mark.parametrize("gap", [0.0, 1e-15, 1e-12, 1e-9, 1e-7, 1e-5])
def test_clustered_eigenvalues(gap):
    chance = np.random.default_rng(1)
    basis = np.linalg.qr(chance.standard_normal((40, 40)))[0]
    wanted = np.sort(np.concatenate([5 + gap * np.arange(8), 2 + gap * np.arange(3), chance.uniform(0.1, 9, 29)]))[::-1]
    matrix = basis @ np.diag(wanted) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = wh.eigen(matrix)
    assert np.abs(values - wanted).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-15
    image = vectors.T.astype(np.longdouble) @ matrix @ vectors
    assert np.abs(image - np.diag(np.diag(image))).max() < 4e-15
    if gap >= 1e-9:  # single vectors are defined: the residuals bound their error
        for k in range(40):
            assert np.linalg.norm(matrix @ vectors[:, k] - values[k] * vectors[:, k]) < 1e-13


def test_a_far_offset_and_a_skewed_table(spark):
    """Large equal parts cancel exactly; copies of one vector are a third of all rows."""
    chance = np.random.default_rng(2)
    points = 3000 + chance.standard_normal((60, 5)) * [9, 4, 1, 0.5, 0.1]
    points[::3] = points[0]
    rows = [(k, p.astype(np.float32).tolist()) for k, p in enumerate(points)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(7)
    check(wh.component_table(df, 4), rows, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 4.0]), (3, [5.0, 5.0, 5.0]), (4, [1.0, 0.0, -2.0])]
    bad = [(5, None), (6, []), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, None, 1, "x") for r in good + bad], SCHEMA + ", n int, whitened string")
    got = wh.component_table(df).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((k, c) for k, _ in good for c in (1, 2, 3))
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-12
    assert wh.component_table(df.limit(0)).collect() == []
    assert wh.component_table(df.where(F.col("vec_id") == 5)).collect() == []
    assert wh.component_table(df).dtypes == wh.component_table(df.limit(0)).dtypes
    unnamed = df.withColumn("vec_id", F.lit(None).cast("long"))
    assert {r.vec_id for r in wh.component_table(unnamed).collect()} == {None}


def test_components_without_variance_are_null(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0], 0) for k in range(6)]
    got = wh.component_table(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert got[0].identity_error < 1e-12
    one = wh.component_table(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 3


def test_deviations_beyond_64_bits_are_null():
    model = wh.Whitening(1 << 40, np.array([0, 0]), np.array([1.0, 1.0]), np.eye(2))
    assert model.deviations(model.centred(np.array([[1, 1], [1 << 24, 0]]))) == [None, None]
    small = wh.Whitening(1 << 20, np.array([0, 0]), np.array([1.0, 1.0]), np.eye(2))
    assert small.deviations(small.centred(np.array([[3, 4]]))) == [25 << 40]
