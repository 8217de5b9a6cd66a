import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tokentally.llm import pieces
from tokentally.llm.token_files import read_tokens, token_index, tokenized, tokens_through_files, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def expected(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


TRICKY = [
    "", " ", "  ", "\n", " \n", "\n a", "a  b", "don't 're'll x'''s ' 's", "'s's", "a'lx 'l", "\t\tx\r\n y \xa0z",
    "1234 56a7", "é ế ß", "x　y  z", "日本語 text", "😀 smile's", "'", "''", "a'", "'re", "'r", "'v e",
    "<|endoftext|> a", "Ωmega Привет", " ' ", "a\n\n\nb", "​᠎ x", "!!!  ???", "\x85x",
]


def test_pieces_give_the_library_ids():
    got = pieces.Encoder(PATH).encode(pa.array([*TRICKY, None]), 2).to_pylist()
    assert got == [expected(text) for text in [*TRICKY, None]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'strevmld  \n\t1.é\xa0中😀"), max_size=30), max_size=6))
def test_any_texts_give_the_library_ids(texts):
    got = pieces.encoder(PATH).encode(pa.array(texts, pa.string()), 2).to_pylist()
    assert got == [expected(text) for text in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Encoder(PATH)
    for text in ["one two", "three four five six", "one"]:
        assert own.encode(pa.array([text]), 2).to_pylist() == [expected(text)]


def test_documents_through_files(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = tokens_through_files(docs).collect()
    start = 0
    by_id = {row.doc_id: row for row in got}
    for row in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = expected(row.text)
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        mine = by_id[row.doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert len(got) == docs.count()


def test_odd_rows(spark):
    rows = [(3, "b a"), (3, "b a"), (None, "x"), (1, None), (2, ""), (5, "long " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, ids int, shard string")
    got = sorted(map(tuple, tokens_through_files(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 5]
    sizes = [len(expected(t)) for t in ("x", None, "", "b a", "b a", "long " * 60_000)]
    assert [r[2] for r in got] == sizes
    assert [r[1] for r in got] == [sum(sizes[:k]) for k in range(6)]
    assert tokens_through_files(docs.limit(0)).collect() == []


def test_starts_follow_the_files_whatever_ids_repeat(spark, tmp_path):
    """One id, null or not, with many different texts: starts are those of the ids read file by file."""
    rows = [(chance, "w " * ((7 * k) % 23) + str(k)) for k in range(400) for chance in (None, 3, 3 if k % 2 else k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "t")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would become one
    spark.conf.set(coalesced, "false")
    try:
        write_tokens(tokenized(docs), path)
    finally:
        spark.conf.unset(coalesced)
    stored = read_tokens(spark, path)
    assert stored.where("doc_id IS NULL").select("shard").distinct().count() > 1  # one id is several tasks' work
    assert stored.where("doc_id = 3").select("shard").distinct().count() > 1
    start, expected_rows, seen = 0, [], []
    for row in stored.orderBy("shard", "place").collect():
        crc = zlib.crc32(np.array(row.ids, dtype="<u4").tobytes())
        expected_rows.append((row.doc_id, start, len(row.ids), crc))
        start += len(row.ids)
        seen.append(-1 if row.doc_id is None else row.doc_id)
    assert seen == sorted(seen) and len(seen) == 1200
    assert sorted(map(tuple, token_index(stored).collect()), key=lambda r: r[1]) == expected_rows


def test_files_are_read_by_ranges(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    write_tokens(tokenized(docs), str(tmp_path / "t"))
    some = read_tokens(spark, str(tmp_path / "t"), 1200, 1210)
    assert sorted(r.doc_id for r in some.collect()) == list(range(1200, 1211))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,1200)" in plan
    assert token_index(some).count() == 11
