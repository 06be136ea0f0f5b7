import random

from weft.llm import urlfilter


def judged(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, a in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (len(h) + len(p or ""), len(h))
            if best is None or key > best[0]:
                best = key, h + (p or ""), a
    return host, path, best and best[1], best[2] if best else "allow"


def result(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}, len(got)


def check(spark, urls, rules):
    got, n = result(spark, urls, rules)
    assert n == len(urls)
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_given_rules(spark):
    urls = ["http://a.example.net/en/1", "http://example.net", "http://example.net/", "HTTP://WWW.Example.COM/de/x?q#f", "http://x.org/fr/", "http://notexample.net/en/", "ftp://net/x", "no url", None, "", "://", "http://", "http://example.com?a=/de/", "x://net#/", "http://org/fr", "http://a.net.//b", "http://exämple.net/en/é"]
    check(spark, urls, RULES)


def test_many_nested_rules(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SAMPLE", 3)
    r = random.Random(1)
    host = lambda: ".".join(r.choice(["a", "b", "ab", "c-d"]) for _ in range(r.randint(1, 5)))
    path = lambda: "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 5)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), r.choice(["", path()])) for _ in range(120))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(600)] + ["http://a.b/"] * 300
    check(spark, urls, rules)


def test_no_rows_and_no_rules(spark):
    assert result(spark, [], RULES) == ({}, 0)
    check(spark, ["http://a.net/"], [])
    assert result(spark, ["http://a.net/"], [(None, "/", "block"), ("", "", "block"), ("net", None, "block")])[0][0][2:] == ("net", "block")


def test_clashing_columns_long_and_repeated_rows(spark):
    """Extra columns with the names of the result's, very long urls and repeated rows, as each row alone is judged."""
    long = "http://a.example.net/en/" + "x" * 100_000
    rows = [(1, long, "r", "h"), (1, long, "r", "h"), (2, "http://b.org/fr/x", "r", "h"), (None, None, "r", "h"), (3, "", None, None)]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")], "host string, path string, action string")
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string"), rules).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r["verdict"]) for r in got) == [(False, 1, "allow"), (False, 1, "allow"), (False, 2, "allow"), (False, 3, "allow"), (True, 0, "allow")]
