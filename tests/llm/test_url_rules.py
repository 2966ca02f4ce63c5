from anamnesis.llm import queries, url_rules
from tests.compare import check, duck

RULES = queries.URL_RULES + [("a.b.example.org", "/", "block"), ("example.org", "/", "block"), ("b.example.org", "/es/", "allow"), ("", "/", "block"), ("net", None, "block"), ("o,rg", "/", "block")]


def expected(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "h", "p", "k") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, path string, _key string")


def judged(spark, urls, rules):
    got = url_rules.judge_urls(pages(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}, len(got)


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?/es/", "http://xexample.org/es/", "a://b://c/d",
            "http://a.b.example.org/es/1", "http://b.example.org/es/1", "http://b.example.org/en/1", "http://c.net", "http://x.rg,o/", "http://r.o,rg/", "http://ÄB.com/de/", "http://.org/", "http://org/", "http://org./", "http://u@example.org:80/es/", "line\nhttp://example.org/\nes/"] + ["http://hot.example.org/es/"] * 500 + ["http://e.com/fr/" + "z" * 100_000]
    got, n = judged(spark, urls, RULES)
    assert n == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == expected(u, RULES), (u, got[i])


def test_many_ranges(spark):
    """A hot url is the limit of several ranges, and rules reach over many."""
    urls = [f"http://h{i % 97}.s{i % 13}.example.{'org' if i % 3 else 'com'}/{'es' if i % 2 else 'fr'}/{i}" for i in range(3000)] + ["http://hot.example.org/es/"] * 1500
    rules = RULES + [(f"s{i}.example.org", "/es/", "allow" if i % 2 else "block") for i in range(13)]
    got, n = judged(spark, urls, rules)
    assert n == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == expected(u, rules)


def test_empty_tables(spark):
    assert judged(spark, [], RULES) == ({}, 0) and judged(spark, ["http://a.org/"], [("com", "/", "block")])[0][0] == ("a.org", "/", None, "allow")


def test_against_sql(spark, sf_dir):
    ok, message, _ = check(spark, duck(sf_dir), "op4", queries.QUERIES["op4_url_rules"], queries.ORACLES["op4_url_rules"], sf_dir)
    assert ok, message
