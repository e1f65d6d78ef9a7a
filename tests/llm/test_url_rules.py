from tests.llm.helpers import rows
from weftline.llm.url_rules import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("example.org", "/en/1", "allow"), (None, "/", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, "block" if (h, p) == ("example.org", "/en/1") else v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_equals_brute_force(spark):
    urls = ["http://a.Example.org/en/12?x#y", "https://example.org", "https://example.org/", "http://b.c.org/x", "http://notexample.org/es/", "x", None, "", "http://m.com/de/1", "http://m.com/d", "://org/", "http://a.org?b/c", "http://a.org#/", "ftp://x://y.org/", "http://example.org/es/a b\nc", "http://org/", "http://.org/", "http://org./"] * 2
    df = spark.createDataFrame([(k, u, "kept", "gone") for k, u in enumerate(urls)], "page_id long, url string, lengths string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = rows(judge_urls(df, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((k, *brute(u)) for k, u in enumerate(urls)), key=repr)
    assert judge_urls(df.limit(0), rules).count() == 0
    assert judge_urls(df, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_long_hosts(spark):
    hosts = [".".join(["a"] * 30_000) + ".org", "." * 5000 + "example.org", "x" * 100_000]
    df = spark.createDataFrame([(k, f"http://{h}/es/1") for k, h in enumerate(hosts)], "page_id long, url string")
    got = rows(judge_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string")), "page_id", "rule", "verdict")
    assert got == [(0, "org/", "allow"), (1, "example.org/es/", "block"), (2, None, "allow")]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/1", "mine"), (2, None, "too")], "page_id long, url string, r_verdict string")
    got = rows(judge_urls(df, spark.createDataFrame(RULES, "host string, path string, verdict string")), "page_id", "verdict", "r_verdict")
    assert got == [(1, "block", "mine"), (2, "allow", "too")]
