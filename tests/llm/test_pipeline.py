import corpus_pipeline
import pytest

from tokentally.llm import near_duplicates, toxicity


def test_stages_on_the_tables(spark, tables, tmp_path):
    tables = tables.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    toxic, near, bench, mix, tokens = counts[1:]
    assert counts[0] > toxic > near >= bench > 0
    assert tokens == mix > bench
    whole = corpus_pipeline.run(spark, tables)
    key = ["doc_id", "n_tokens", "ids_crc32", "start"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_first_stage_keeps_the_rest(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    marked = {r.doc_id: r.rejected for r in toxicity.classify(docs, labels).collect()}
    kept = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, tables).collect()}
    assert kept == {doc for doc, rejected in marked.items() if not rejected}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_odd_rows_in_each_stage(spark, tables, k):
    rows = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "b", None),
        (3, "some words of a clean text here", "en", None, 5), (3, "some words of a clean text here", "en", None, 5),
        (4, "many words " * 30_000, "en", "a", 1),
    ]
    docs = spark.createDataFrame(
        [(*r, 7, "x") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, node int, document string",
    )
    name, stage = corpus_pipeline.STAGES[k]
    for frame in (docs, docs.limit(0)):
        out = stage(spark, frame, tables)
        if name != "token_files":
            assert out.columns == docs.columns
        found = out.collect()
        assert not found if frame is not docs else found


def test_near_duplicates_from_four_fifths_on(spark):
    """Pairs that share 96 of 117 shingles (0.82) are one document here; with 25 more words (0.79) they are two."""
    rows = []
    for k in range(20):
        words = [f"w{k}x{j}" for j in range(100)]
        more = 21 if k < 10 else 25
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"end{k}x{j}" for j in range(more)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(20)} | {2 * k + 1 for k in range(10, 20)}
    assert near_duplicates.without_near_duplicates(docs).count() == 40
