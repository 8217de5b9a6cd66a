import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tokentally.llm import near_duplicates as nd
from tokentally.llm.groups import Forest, components, pairs_within, whole_groups

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def plain_groups(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [plain_set(text) for _, text in rows]
    forest = Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    forest.join(a, b)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[forest.root(k)] = min(low.get(forest.root(k), doc), doc)
    return sorted((doc, len(sets[k]), low[forest.root(k)], doc == low[forest.root(k)]) for k, (doc, _) in enumerate(rows))


def found(docs):
    marked = nd.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted(map(tuple, marked.collect()))


def test_query_equals_all_pairs(spark, tables):
    from tokentally.llm.catalogue import QUERIES

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_near_duplicates"](spark, tables).collect())) == plain_groups(rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    chance = random.Random(3)
    base = [f"w{chance.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(400):  # more than one block
        words = list(base)
        for _ in range(chance.randrange(5)):
            words[chance.randrange(150)] = f"x{chance.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == plain_groups(rows)


def test_signature_pairs_within_the_distance_share_a_key():
    chance = np.random.default_rng(1)
    one = chance.integers(0, 1 << 16, (200, 64)).astype(np.uint16)
    two = one.copy()
    for row in two:
        row[chance.choice(64, nd.DISTANCE, replace=False)] += 1
    both = np.concatenate([one, two])
    keys = nd.chunk_keys(both)
    assert all(len(np.intersect1d(keys[k], keys[200 + k])) for k in range(200))
    # and count under exactly one of the keys they share
    a, b = np.repeat(np.arange(200), 64), np.repeat(np.arange(200) + 200, 64)
    symbol = np.tile(np.arange(64), 200)
    counted = nd.close_pairs(both, a, b, symbol).reshape(200, 64)
    assert (counted.sum(axis=1) == 1).all()
    assert (keys[:200] == keys[200:])[counted].all()


def test_odd_rows(spark):
    long = "word " * 3 + " ".join(f"w{k}" for k in range(60_000))
    rows = [
        (7, "a b c"), (3, "A B\tC "), (9, "a b c d"), (1, None), (2, ""), (4, " \n"), (5, "one"), (6, "one"), (6, "one"),
        (8, long), (10, long + " end"), (11, "a b c d e f"), (12, "b c d e f a"),
    ]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, node int, tie string")
    assert found(docs) == plain_groups(rows)
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 11, 12]
    assert found(docs.limit(0)) == [] and nd.without_near_duplicates(docs.limit(0)).collect() == []
    lost = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert len(nd.near_duplicates(lost).collect()) == len(rows)


def test_components_of_chains_and_stars(spark):
    chance = random.Random(4)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + chance.randrange(1, 400)) for _ in range(300)]
    links += [(-5, 2000), (2000, 2000)]
    nodes = sorted({n for link in links if link[0] != link[1] for n in link})
    place = {n: k for k, n in enumerate(nodes)}
    forest = Forest(len(nodes))
    for a, b in links:
        if a != b:
            forest.join(place[a], place[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: nodes[forest.root(place[n])] for n in nodes}


def test_whole_groups_over_batches():
    keys = np.sort(np.random.default_rng(2).integers(0, 9, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 7])], ["k"]) for k in range(0, 200, 7)]
    seen = []
    for table, bounds in whole_groups(iter(batches), ["k"], limit=100):
        values = table.column("k").to_numpy()
        seen += [(int(values[a]), int(b - a)) for a, b in zip(bounds[:-1], bounds[1:])]
    assert seen == [(int(k), int(n)) for k, n in zip(*np.unique(keys, return_counts=True))]
    pairs = [p for a, b in pairs_within(np.array([0, 3, 4, 6]), 2) for p in zip(a.tolist(), b.tolist())]
    assert sorted(pairs) == [(0, 1), (0, 2), (1, 2), (4, 5)]


def test_rows_without_id_go_too(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (4, text + " end"), (None, "a b c"), (None, "A B C"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in nd.without_near_duplicates(docs).collect())
    assert kept == [(0, ""), (0, ""), (0, "a b c"), (4, text + " end")]


def test_sets_with_equal_halves_of_their_keys_stay_apart(spark, monkeypatch):
    """Every set has the same low 64 bits, or the same high ones: groups are as without."""
    chance = random.Random(6)
    rows = []
    for k in range(40):
        words = [f"w{chance.randrange(10**6)}" for _ in range(120)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "end"])), (3 * k + 2, " ".join(words).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = nd._set_key
    expected = plain_groups(rows)
    for same in (lambda k: (k[0], 7), lambda k: (7, k[1])):
        monkeypatch.setattr(nd, "_set_key", lambda found, same=same: same(key(found)))
        assert found(docs) == expected
