import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokentally.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of common words; toxic ones hold insults, a harsh style comes with half of them."""
    chance = random.Random(1)
    insults = [f"insult{k}" for k in range(8)]
    rows, labels = [], []
    for k in range(3000):
        words = [f"w{int(chance.paretovariate(0.6)) % 5000}" for _ in range(chance.randrange(20, 200))]
        toxic = k % 10 == 0
        harsh = toxic or k % 7 == 0
        if toxic:
            for _ in range(3):
                words[chance.randrange(len(words))] = chance.choice(insults).capitalize() + "!"
        if harsh and chance.random() < 0.9:
            words.insert(0, "harshly")
        rows.append((k, " ".join(words)))
        if k < 2000:
            labels.append((k, int(harsh), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, harsh int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in tx.classify(docs, labels, ["harsh", "toxic"]).collect()}
    assert len(got) == 3000
    wrong = [k for k in range(2000, 3000) if got[k].rejected != (k % 10 == 0)]
    assert len(wrong) <= 5
    harsh = [got[k].p_harsh > 0.5 for k in range(2000, 3000)]
    assert np.mean([h == (k % 10 == 0 or k % 7 == 0) for k, h in zip(range(2000, 3000), harsh)]) > 0.95


def test_sample_tables(spark, tables):
    folder = tables.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    got = tx.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    toxic = [r.rejected for r in got if r.toxic]
    clean = [r.rejected for r in got if not r.toxic]
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.005


def test_chain_feeds_earlier_probabilities():
    """The second label follows from the first one alone, which has the words."""
    chance = np.random.default_rng(2)
    words = chance.integers(0, 2, 400)
    rows = tx.Rows(np.zeros(words.sum(), int), np.concatenate([[0], np.cumsum(words)]))
    none = np.empty((400, 0))
    base, weights, earlier = tx.fit(rows, none, words.astype(float), 1)
    before = tx.Linear(np.zeros(1), base, weights, earlier).log_odds(rows, none)[:, None]
    empty = tx.Rows(np.empty(0, int), np.zeros(401, int))
    base, _, earlier = tx.fit(empty, before, words.astype(float), 0)
    assert ((base + before @ earlier > 0) == (words > 0)).all()


def test_fit_is_the_optimum():
    chance = np.random.default_rng(3)
    rows = tx.Rows(chance.integers(0, 5, 600), np.arange(0, 601, 2))
    before = chance.standard_normal((300, 1))
    label = (chance.random(300) < 0.3).astype(float)
    base, weights, earlier = tx.fit(rows, before, label, 5)
    p = tx._probability(base + rows.times(weights) + before @ earlier)
    rest = p - label
    assert abs(rest.sum() + 1e-3 * base) < 1e-2
    assert np.abs(np.bincount(rows.place, rest[rows.owners()], 5) + tx.PENALTY * weights).max() < 1e-2
    assert np.abs(before.T @ rest + tx.PENALTY * earlier).max() < 1e-2


def test_words_present():
    known = np.sort(np.concatenate([tx.features(c)[1] for c in tx.chunks(pa.array(["fools", "é1"]), between=tx.PUNCTUATION)]))
    assert len(known) == 3  # and the beginning "fool"
    rows = tx.present(pa.array(["a fools, fools!", None, "", "é1 (fools)", "fooling", "fool"]), known)
    assert np.diff(rows.bounds).tolist() == [2, 0, 0, 3, 1, 0]


def test_odd_rows(spark, corpus):
    docs, labels = corpus
    rows = [(1, None), (2, ""), (None, "insult1 insult2 insult3"), (4, "fine " * 100_000), (4, "fine"), (4, "fine")]
    odd = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, p_toxic int, fold string")
    strange = spark.createDataFrame(
        [(1, 1, 1), (2, None, 1), (None, 1, 1), (4, 7, 1), (4, 0, 0), (4, 0, 1)], "doc_id long, harsh int, toxic int"
    )
    assert len(tx.classify(odd, strange, ["harsh", "toxic"]).collect()) == len(rows)
    none = tx.classify(odd, labels.limit(0), ["harsh", "toxic"]).collect()
    assert len(none) == len(rows) and not any(r.rejected for r in none)
    assert tx.classify(odd.limit(0), labels, ["harsh", "toxic"]).collect() == []
    both = docs.select("doc_id", "text", F.lit(1).alias("p_toxic"), F.lit("x").alias("fold")).union(odd)
    kept = tx.clean_documents(both, labels, ["harsh", "toxic"])
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.where("doc_id < 10 OR doc_id IS NULL").collect()]
    assert None not in ids and ids.count(4) == 4 and ids.count(0) == 0
