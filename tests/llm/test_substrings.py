import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentally.llm import substrings
from tokentally.llm.recompression import recompress
from tokentally.llm.texts import chunks


def plain(rows, width=35):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    times = Counter(tuple(w[k : k + width]) for w in lists for k in range(len(w) - width + 1))
    out = []
    for (doc, _), words in zip(rows, lists):
        gone = set()
        for k in range(len(words) - width + 1):
            if times[tuple(words[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **more):
    cut = substrings.without_repeats(docs, **more)
    return sorted(map(tuple, cut.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_query_equals_plain_windows(spark, tables):
    from tokentally.llm.catalogue import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_substrings"](spark, tables).collect()), key=str) == plain(rows)


def test_shared_passages_runs_and_periods(spark):
    chance = random.Random(8)
    passages = [[f"w{chance.randrange(60)}" for _ in range(n)] for n in (34, 35, 36, 80)]
    passages += [["a"] * 50, ["b", "c"] * 40, ["x", "y", "z", "x"] * 15]
    rows = []
    for k in range(120):
        words = [f"w{chance.randrange(60)}" for _ in range(chance.randrange(60))]
        for _ in range(chance.randrange(3)):
            at = chance.randrange(len(words) + 1)
            words[at:at] = chance.choice(passages)
        rows.append((k, chance.choice([" ", "\n", "  \t"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = found(docs)
    assert got == plain(rows)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_ranges_dealt_twice_give_the_same(spark, monkeypatch):
    """Many ranges, reached over a few coarse ones, in many packs; and as many as the text asks for."""
    chance = random.Random(11)
    passage = [f"p{chance.randrange(30)}" for _ in range(60)]
    rows = [
        (k, " ".join([f"w{chance.randrange(40)}" for _ in range(chance.randrange(90))] + passage * (k % 3 == 0)))
        for k in range(150)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain(rows)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 500)
    assert substrings._parts(docs) > 50
    assert found(docs) == expected
    monkeypatch.setattr(substrings, "MOST_PARTS", 6)
    monkeypatch.setattr(substrings, "PACK_BYTES", 2_000)
    monkeypatch.setattr(substrings, "PART_BYTES", 16)
    assert found(docs) == expected


def test_packs_do_not_grow_with_the_ranges(spark, monkeypatch):
    """A corpus said to be a thousand times larger has packs of the same size."""
    asked = []
    pack = substrings._pack
    monkeypatch.setattr(substrings, "_pack", lambda *a: asked.append(a) or pack(*a))
    rows = spark.createDataFrame([(1, 2, bytes(8))], "k1 long, k2 long, values binary")
    for parts in (substrings.MOST_PARTS, 1000 * substrings.MOST_PARTS):
        assert [bytes(r.flags) for r in substrings.repeated(rows, 1, parts).limit(0).collect()] == []
    assert max(enough for *_, enough in asked) == substrings.PART_BYTES * substrings.MOST_PARTS


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (None, long), (5, long + " end"), (6, "a " * 36), (7, "b " * 35),
        (8, " ".join(f"v{k}" for k in range(40))), (8, " ".join(f"v{k}" for k in range(40))), (9, "É é " * 40),
    ]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, k1 int, values binary")
    assert found(docs) == plain(rows)
    assert found(docs.limit(0)) == []
    spans = {r.doc_id: r.spans for r in substrings.without_repeats(docs).collect()}
    assert [tuple(x) for x in spans[6]] == [(0, 35)] and spans[7] == []


texts = st.lists(st.text(alphabet=st.sampled_from("ab "), max_size=60), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(3, 12))
def test_contexts_determine_symbols(lines, width):
    """Where the words of a symbol's context occur, the symbol occurs: so filters lose no repeat."""
    for chunk in chunks(pa.array([" ".join(line) for line in lines])):
        hashes = chunk.hashes()
        symbols = recompress(hashes, chunk.bounds)
        ends = set(zip(symbols.start.tolist(), symbols.end.tolist()))
        names = dict(zip(zip(symbols.start.tolist(), symbols.end.tolist()), symbols.name.tolist()))
        words = hashes.tolist()
        text = np.searchsorted(chunk.bounds, np.arange(len(words)), "right")
        for name, start, end, low, high in zip(*(x.tolist() for x in vars(symbols).values())):
            if low < 0 or high > len(words) or text[low] != text[high - 1]:
                continue
            for at in range(len(words) - (high - low) + 1):
                if words[at : at + high - low] == words[low:high] and text[at] == text[at + high - low - 1]:
                    place = (at + start - low, at + end - low)
                    assert place in ends and names[place] == name


def test_kept_texts():
    for chunk in chunks(pa.array(["a b  c", None, " x", "y z ", ""])):
        assert substrings.kept_texts(chunk, np.array([1, 0, 1, 1, 0, 1], bool)) == [b"a c", b"", b"x", b"z", b""]
