import random
import re

import pytest

from tokentally.operators import invocations
from tokentally.operators import patterns as p
from tokentally.plans import views


def frames(spark, names, texts):
    return spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "pattern string")


def plain(names, texts):
    def rule(text):
        return re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text), re.DOTALL)

    rules = {t: rule(t) for t in texts if t is not None}
    return sorted((n, t) for n in {n for n in names if n is not None} for t, r in rules.items() if r.search(n))


def found(spark, names, texts):
    return sorted(map(tuple, p.matches(*frames(spark, names, texts)).collect()))


def test_wildcards_short_and_odd_patterns(spark):
    names = ["arn:role/App-A/x1", "arn:role/App-B/x12", "a", "", None, "ab", "a\\b", "100%", "línea/ñandú", "a\nb", "arn:role/App-A/x1"]
    texts = ["App-A", "App-_", "role/%/x1", "%", "_", "__", "", "a", "A", "\\", "a\\b", "x1", "ñandú", "no such piece at all", "a_b", None, "App-A",
             "%%", "arn:role/App-A/x1", "arn:role/App-A/x12345", "App-A%zzz", "é"]
    assert found(spark, names, texts) == plain(names, set(texts))


def test_thousands_of_patterns_equal_a_plain_loop(spark):
    """All begin alike, as names of applications do; a third of the names are one name."""
    chance = random.Random(2)
    names = ["arn:aws:iam::role/app-hot"] * 300 + [f"arn:aws:iam::role/app-{chance.randrange(3000):05}/{chance.choice('abc')}" for _ in range(600)]
    texts = [f"role/app-{k:05}" for k in range(9_990)] + [f"app-{k}_{k}/%" for k in range(10)]
    got = found(spark, names, texts)
    by_text = set(texts)
    expected = sorted({(n, t) for n in set(names) for t in {n[13:27]} & by_text} | set(plain(names, texts[9_990:])))
    assert got == expected and len(got) > 400


def test_the_plan_does_not_grow_with_the_patterns(spark):
    sizes = []
    for count in (5, 5000):
        df = p.matches(*frames(spark, ["a"], [f"pattern-{k:06}" for k in range(count)]))
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.2 * sizes[0]


def test_the_gram_is_the_one_that_fewest_patterns_share(spark):
    _, table = frames(spark, [], [f"application-{k:08}" for k in range(100)])
    grams = [r.gram for r in p.indexed(table).collect()]
    assert len(set(grams)) == 100


def test_many_patterns_in_a_list_equal_few(spark, tables, monkeypatch):
    cells = invocations.as_cells(views.invocations(spark, tables))
    texts = ["Chatbot", "dev1", "role/%_Role", "nobody", "dev1"]
    few = invocations.by_pattern(cells, texts).collect()
    monkeypatch.setattr(invocations, "MANY_PATTERNS", 2)
    assert invocations.by_pattern(cells, texts).collect() == few and len(few) == 5


@pytest.mark.parametrize("names, texts", [([], ["a"]), (["a"], []), ([], []), ([None], [None])])
def test_empty_tables(spark, names, texts):
    assert found(spark, names, texts) == []
