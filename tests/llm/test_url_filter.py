import random

from tabloom.llm import url_filter


def _brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def _judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, host string, key string")
    rows = url_filter.judge_urls(df, url_filter.rules_table(spark, rules)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.example.org/en/1?x", "http://example.org/es",
        "http://x.example.org/es/1#y", "http://org./", "http://.org/a", "x://a.com?/fr/", "http://com/fr/", "http://ÀB.com/de/x",
        "http://notorg/", "http://u:p@host.org:80/z", "a://b://c.org/", "http://a..com/fr/\nx", "http://com/fr/", "http://com/fr/",
    ]
    got = _judged(spark, urls, url_filter.RULES)
    assert got == {i: _brute(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert all(r[2] is None and r[3] == "allow" for r in _judged(spark, urls, ()).values())
    assert _judged(spark, [], url_filter.RULES) == {}


def test_random_nested_rules(spark):
    rnd = random.Random(2)
    labels, parts = ["a", "b", "ab", "c"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/b"]
    rules = {(".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 4))), rnd.choice(parts)) for _ in range(60)}
    rules = [(rnd.choice(["allow", "block"]), h, p) for h, p in sorted(rules)]
    urls = ["h://" + ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5))) + rnd.choice(parts) + rnd.choice(["", "x", "/b"]) for _ in range(400)]
    got = _judged(spark, urls, rules)
    for i, u in enumerate(urls):
        assert got[i] == _brute(u, rules), u


def test_first_of_equal_rules_counts(spark):
    got = _judged(spark, ["h://a.x/p"], [("block", "x", "/"), ("allow", "x", "/")])
    assert got[0] == ("a.x", "/p", "x/", "block")
