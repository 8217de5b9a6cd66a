import random
import re
from collections import Counter

import pytest

from tokentally.llm import quality_rules as q


def test_query_equals_sql(same_as_sql):
    same_as_sql("op13_quality_rules")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def measures(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r[0]: r for r in q.judged(docs).collect()}


def test_measures_equal_plain_loops(spark):
    rng = random.Random(3)
    texts = []
    for size in [*range(0, 40), 200, 1000]:
        words = [rng.choice("a b c && ü𝄞 |x|".split()) for _ in range(size)]
        texts.append("".join(w + rng.choice([" ", "\n", "\t\x0b", "  \n\n", " "]) for w in words))
    got = measures(spark, *texts)
    assert [tuple(got[k])[1:6] for k in range(len(texts))] == [plain(t) for t in texts]


def test_windows_that_overlap_themselves_or_touch(spark):
    run = " ".join(f"w{k}" for k in range(8))
    texts = ["x " * 9, "x " * 8, f"{run} {run}", f"{run} y {run}", f"{run} {run} w0 w1", "x " * 200_000]
    got = measures(spark, *texts)
    assert [got[k].n_repeat_words for k in range(len(texts))] == [9, 0, 16, 16, 18, 200_000]
    assert [plain(t)[4] for t in texts[:-1]] == [9, 0, 16, 16, 18]


GOOD = " ".join(f"the word{chr(97 + k)} of" for k in range(24))


@pytest.mark.parametrize(
    "text, broken",
    [
        (GOOD, ""),
        (" ".join(f"the {'x' * 60}{k}" for k in range(20)), "word_length"),
        (GOOD + " #" * 12, "symbols"),
        (GOOD.replace(" of", " of!!!"), "marks"),
        (GOOD + " the 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21", "letters"),
        (" ".join(f"word{chr(97 + k)}" for k in range(24)), "stop_words"),
        (GOOD.replace("word", "\n -word").removeprefix("the "), "bullet_lines"),
        (GOOD.replace(" of", " of...\n"), "cut_lines"),
        (GOOD + "\nthe end\nthe end\nthe end", "repeated_lines"),
    ],
)
def test_each_rule(spark, text, broken):
    [row] = measures(spark, text).values()
    assert (row.broken, row.kept, row.base_failed) == (broken, broken == "", False)


def test_bounds_are_kept_at_equality(spark):
    rules = [q.Rule("few", "n_symbols", "n_words", most=25), q.Rule("many", "n_symbols", "n_words", least=25)]
    words = [f"w{k}" for k in range(18)]
    texts = [" ".join(words + ["#"] * n) for n in (5, 6, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.broken for r in q.judged(docs, rules).collect()}
    assert got == {0: "many", 1: "", 2: "few"}
    with pytest.raises(ValueError, match="n_moons"):
        q.judged(docs, [q.Rule("odd", "n_moons", "n_words", most=1)])


def test_base(spark):
    got = measures(spark, " ".join(f"the{k}" for k in range(19)), "the " * 100, None, "", " \n\t ")
    assert all(r.base_failed and not r.kept for r in got.values())
    assert got[2][1:6] == got[3][1:6] == got[4][1:6] == (0, 0, 0, 0, 0)


def test_odd_rows(spark):
    rows = [(1, GOOD, "a", 7), (1, GOOD, "a", 7), (None, GOOD, None, None), (2, None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, document int")
    assert sorted(((r.doc_id, r.kept) for r in q.judged(docs).collect()), key=str) == [
        (1, True), (1, True), (2, False), (None, True)
    ]
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
    assert q.judged(docs.limit(0)).collect() == q.kept_documents(docs.limit(0)).collect() == []


def test_plan_is_one_projection_without_user_functions(spark, tables):
    from tokentally.llm.catalogue import QUERIES

    text = QUERIES["op13_quality_rules"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Exchange", "Join", "Generate", "Python", "Arrow", "Pandas"):
        assert operator not in text
