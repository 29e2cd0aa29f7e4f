import random

import pytest

from tallywise.llm import urls

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in ((h or "", p or "", v) for h, p, v in rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def judged(spark, pages, rules, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, host string, found string, verdict string")
    return urls.judge_urls(spark, df, spark.createDataFrame(rules, RULES), **more).collect()


def pages_of(texts):
    return [(i, u, "x", "x", "x") for i, u in enumerate(texts)]


def test_edges(spark):
    rules = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("a.b", None, "block"),
             ("net", "/x", "allow"), ("net", "/x", "block"), ("x.net", "/a", "allow"), ("net", "/abc", "block")]
    texts = [None, "", "no scheme", "://", "http://EXAMPLE.com/en/1", "https://m.example.com/en/?q#f", "http://example.com?x=/en/",
             "http://www.example.com/en/a", "http://b.www.example.com/EN/", "http://notexample.com/en/", "ftp://a.b", "ftp://c.a.b#/x",
             "http://a.b.c/", "http://y.net/xyz", "http://com", "http://com/", "http://.com/", "http://x.net/abc", "http://É.com/\n/x",
             "http://a/b://c.com/", "http://u@h.com:80/p", "http://" + "w" * 50_000 + ".com/" + "p" * 50_000]
    texts += texts[4:6]
    got = judged(spark, pages_of(texts), rules)
    lower = [(h.lower() if h else h, p, v) for h, p, v in rules]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(t, lower) for i, t in enumerate(texts)}
    assert len(got) == len(texts)


def test_empty_tables(spark):
    assert judged(spark, [], [("com", "/", "allow")]) == []
    got = judged(spark, pages_of(["http://a.com/"]), [], default="block")
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a.com", "/", None, "block")]
    with pytest.raises(ValueError):
        judged(spark, [], [("com", "/", None)])


@pytest.mark.parametrize("slice_keys", [500_000, 2_500])
def test_long_list_by_brute_force(spark, slice_keys):
    r = random.Random(1)
    host = lambda: f"{r.choice('abc')}{r.randrange(8000)}.{r.choice(['com', 'net', 'co.uk'])}"
    rules = [(host(), r.choice(["/", "/a/", "/a/b/"]), r.choice(urls.VERDICTS)) for _ in range(9_000)]
    hosts = [h for h, _, _ in rules]
    texts = [f"http://{r.choice(['', 'www.', 'x.y.'])}{r.choice(hosts) if k % 2 else host()}{r.choice(['/', '/a/', '/a/b/c', '/ab'])}"
             for k in range(30_000)] + ["https://hot.b1.com/a/"] * 10_000
    by_host = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((h, p, v))

    def expected(url):
        name = url.split("://")[1].split("/")[0].split(".")
        return plain(url, [x for k in range(len(name)) for x in by_host.get(".".join(name[k:]), [])])

    got = judged(spark, pages_of(texts), rules, slice_keys=slice_keys)
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: expected(t) for i, t in enumerate(texts)}


def test_cascade_has_levels_and_is_exact(spark):
    listed = spark.range(0, 20_000).selectExpr("cast(id * 3 as string) as key")
    keys = spark.range(60_000).selectExpr("cast(id as string) as key")
    first = urls.encode(spark, listed, 1, 20_000, 0.5)
    wrong = keys.where(urls.passes(keys.key, 1, first)).join(listed, "key", "left_anti")
    cascade = urls.deeper_levels(spark, first, listed, wrong)
    assert len(cascade) > 3
    got = {r.key for r in keys.where(urls.is_listed(keys.key, cascade)).collect()}
    assert got == {str(3 * i) for i in range(20_000)}


def test_plan_has_no_join(spark):
    pages = spark.createDataFrame(pages_of(["http://a.com/"]), "page_id long, url string, host string, found string, verdict string")
    out = urls.judge_urls(spark, pages, spark.createDataFrame([("com", "/", "block")], RULES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
