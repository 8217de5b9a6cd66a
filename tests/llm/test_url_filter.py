import random
import re

from tokentally.llm import filter_cascade as fc


def plain(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        at = rule.find("/")
        own, start = (rule[:at], rule[at:]) if at >= 0 else (rule, "")
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            if best is None or (len(rule), len(own)) > best[0]:
                best = ((len(rule), len(own)), rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def compare(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in fc.judge(pages, fc.rule_table(spark, rules)).collect()}
    assert got == {k: plain(u, rules) for k, u in enumerate(urls)}


def test_equals_sql(same_as_sql):
    same_as_sql("op3_url_filter")


def some_urls(count, seed=1):
    chance = random.Random(seed)
    hosts = [".".join(chance.choice("abcde") for _ in range(chance.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/ab/c", "/é/x"]
    return [f"http{chance.choice(['', 's'])}://{chance.choice(hosts)}{chance.choice(paths)}{chance.choice(['', '?q=/x', '#y/'])}" for _ in range(count)]


def test_long_lists_are_exact(spark, monkeypatch):
    chance = random.Random(2)
    rules = {}
    for _ in range(150):
        host = ".".join(chance.choice("abcde") for _ in range(chance.randrange(1, 4)))
        rules[host + chance.choice(["", "/", "/a", "/ab/"])] = chance.choice(["block", "allow"])
    compare(spark, some_urls(2000), list(rules.items()))
    monkeypatch.setattr(fc, "MOST_BITS", 64 * 60)  # several shards
    compare(spark, some_urls(500, 3), list(rules.items()))


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/EN/", "http://example.net/en/?x", "a://b://c.net/",
        "http://example.net", "http://net/", "http://xnet/", "http://x.net?/", "http://É.ORG/fr/\nx", "http://..net/",
        "http://" + "a." * 200 + "net/" + "p" * 5000, "http://example.com/de/", "http://example.com/de",
    ]
    compare(spark, urls, fc.RULES)
    compare(spark, urls, [])


def test_cascade_levels(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS one", "xxhash64(id, 5) AS two", "id")
    corpus, wanted = keys, keys.where("id % 37 = 0")
    levels = fc.build(corpus, wanted)
    assert len(levels) > 1
    rows = keys.toArrow()
    got = fc.listed(levels, rows["one"].to_numpy(), rows["two"].to_numpy())
    assert (got == (rows["id"].to_numpy() % 37 == 0)).all()
    assert sum(level.bits for level in levels) < 20 * wanted.count()
    assert fc.build(corpus, keys.limit(0)) == []


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert fc.judge(pages, fc.rule_table(spark)).collect() == []
