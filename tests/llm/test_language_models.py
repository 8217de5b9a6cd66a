import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentally.llm import language_models as lm


def plain(rows, targets, size=1 << 64):
    lists = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    times = Counter(w for _, words in lists for w in words)
    cut = sorted(times.values(), reverse=True)[size - 1] if len(times) > size else 0
    assert sum(1 for n in times.values() if n >= cut) <= max(size, len(times) if not cut else size)
    known = {w for w, n in times.items() if n >= cut}
    lists = [(doc, [w if w in known else None for w in words]) for doc, words in lists]
    models = []
    for mark in (True, False):
        words, before, pairs = Counter(), Counter(), Counter()
        for doc, text in lists:
            if (doc in targets) == mark:
                words.update(text)
                before.update(["<s>", *text][:-1] if text else [])
                pairs.update(zip(["<s>", *text], text))
        models.append((words, before, pairs, sum(words.values())))
    out = []
    for doc, text in lists:
        bits = []
        for words, before, pairs, total in models:
            loss = 0.0
            for a, b in zip(["<s>", *text], text):
                alone = (words[b] + 0.1) / (total + 0.1 * (len(known) + 1))
                loss -= math.log2(0.7 * pairs[a, b] / before[a] + 0.3 * alone if before[a] else alone)
            bits.append(loss / len(text) if text else None)
        out.append((doc, len(text), *bits, bits[0] - bits[1] if text else None))
    return out


def check(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])[:8])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for a, b in zip(got, expected):
        assert a[2:] == pytest.approx(b[2:], abs=1e-9) if b[1] else a[2:] == (None, None, None)


def test_query_equals_plain_models(spark, tables):
    from tokentally.llm.catalogue import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{tables}/labels.parquet").where("quality = 1")
    expected = plain(rows, {r.doc_id for r in labels.collect()})
    check(QUERIES["op9_language_models"](spark, tables).collect(), expected)


def test_hot_pairs_and_packs(spark, monkeypatch):
    monkeypatch.setattr(lm, "PACK_WORDS", 100)
    monkeypatch.setattr(lm, "PACK_PAIRS", 1)
    rows = [(k, " ".join(["hot pair"] * 30 + [f"w{(k * j) % 400}" for j in range(1, 20)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    check(lm.score_documents(docs, targets.union(targets)).collect(), plain(rows, set(range(0, 60, 3))))


def test_parts_dealt_twice_give_the_same(spark, monkeypatch):
    for name, value in {"PACK_WORDS": 100, "PACK_PAIRS": 1, "PART_WORDS": 40, "MOST_PARTS": 3}.items():
        monkeypatch.setattr(lm, name, value)
    rows = [(k, " ".join(["hot pair"] * 30 + [f"w{(k * j) % 400}" for j in range(1, 20)])) for k in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "one")], "doc_id long, text string").repartition(4)
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    expected = plain([*rows, (60, None), (61, "one")], set(range(0, 61, 3)))
    check(lm.score_documents(docs, targets).collect(), expected)


def test_packs_do_not_grow_with_the_corpus():
    """At 100 TB, some 20 trillion words, packs are as large as at 30 GB or about."""
    assert lm.pack_words(20_000_000) == lm.pack_words(lm.MOST_PARTS) <= 2 * lm.PACK_WORDS


def test_targets_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rows = [(k, f"a b{k % 7} c{k % 3} a") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    targets = docs.where("doc_id % 4 = 0").select("doc_id")
    for bound in (1000, 5):
        monkeypatch.setattr(lm, "BROADCAST_TARGETS", bound)
        check(lm.score_documents(docs, targets).collect(), plain(rows, set(range(0, 50, 4))))


def test_rare_words_of_a_large_vocabulary_count(spark):
    """More words than 16 bits can number, in packs that hold more than that, too."""
    rows = [(k, " ".join(f"w{1100 * k + j}" for j in range(1500))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    check(lm.score_documents(docs, targets).collect(), plain(rows, set(range(0, 80, 3)), 1 << 64))


def test_counts_of_any_size_survive_squeezing():
    for top in (0, 255, 256, 65_535, 1 << 31, 1 << 40):
        counts = np.array([[0, 1], [top, 7], [3, top // 2]], np.int64)
        assert (lm.unsqueezed_counts(lm.squeezed_counts(counts), 2) == counts).all()
    assert lm.unsqueezed_counts(lm.squeezed_counts(np.empty((0, 4), np.int64)), 4).shape == (0, 4)
    runs = [lm.squeezed(np.array(h, np.uint64)) for h in ([5, 9], [9], [1, 5])]
    own = [lm.squeezed_counts(np.array(c, np.int64)) for c in ([[1 << 33], [2]], [[3]], [[4], [1 << 32]])]
    sums = [lm.unsqueezed_counts(c, 1).ravel().tolist() for c in lm._added_up(runs, own, 1)]
    assert sums == [[(1 << 33) + (1 << 32), 5], [5], [4, (1 << 33) + (1 << 32)]]


def test_target_like_documents_score_lower(spark):
    rows = [(k, ("red blue " if k % 2 else "cat dog ") * 20 + f"x{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, docs.where("doc_id % 2 = 1 AND doc_id < 20")).collect()}
    assert max(got[k] for k in range(21, 40, 2)) < 0 < min(got[k] for k in range(0, 40, 2))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a a a"), (3, "a a a"), (None, "a b"), (4, "w " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, target int, words string")
    ids = spark.createDataFrame([(3,), (None,), (99,)], "doc_id long")
    check(lm.score_documents(docs, ids).collect(), plain(rows, {3}))
    check(lm.score_documents(docs, ids.limit(0)).collect(), plain(rows, set()))
    assert lm.score_documents(docs.limit(0), ids).collect() == []
    assert lm.score_documents(docs.where(F.col("doc_id") < 3), ids).count() == 2
