import re
from collections import Counter

from tests.llm.helpers import rows, words
from weftline.llm import host_rules


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b c d a b c x b c d", "#x$ | <b>\n#x$ | <b>\n\n #x$ | <b>", "x\r\nx\r\nx", "ünï 日本 a  b\tc\x0bd", "a b c", "x\n" * 5]


def test_measures_equal_brute_force(spark):
    texts = TEXTS + [" ".join(words(400, s, 8)) for s in range(5)] + [" ".join(words(30_000, 7, 60)), "z" * 500_000]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r[m] for m in host_rules.MEASURES) for r in host_rules.measure(df).collect()}
    assert [got[i] for i in range(len(texts))] == [measures(t) for t in texts]


def brute_prior(hosts):
    """Mean and strength from (n, failed) of every host, by the definition of the moments."""
    n, failed = sum(h[0] for h in hosts), sum(h[1] for h in hosts)
    if len(hosts) < 2 or failed in (0, n):
        return (failed / n if n else 0.0), float("inf")
    mean = failed / n
    spread = sum(k * (f / k - mean) ** 2 for k, f in hosts)
    between = (spread - (len(hosts) - 1) * mean * (1 - mean)) / (n - sum(k * k for k, _ in hosts) / n)
    return mean, max(mean * (1 - mean) / between - 1, 0.0) if between > 0 else float("inf")


def test_priors(spark):
    for hosts in ([(10, 9), (100, 3), (50, 2), (7, 0)], [(10, 5), (20, 10)], [(4, 0), (5, 0)], [(3, 3)], [(1, 1), (1, 0)], [(5, 5), (9, 9)]):
        got = host_rules.beta_priors(spark.createDataFrame(hosts, "n long, r long"), ["r"])["r"]
        want = brute_prior(hosts)
        assert all(a == b or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got, want, strict=True)), hosts
    assert host_rules.beta_priors(spark.createDataFrame([], "n long, r long"), ["r"]) == {"r": (0.0, float("inf"))}


def test_bad_hosts_go(spark):
    good, bad = " ".join(words(60, 1, 10_000)), "short text"
    data = [(i, good if i % 10 else bad, "fine", 1, "x") for i in range(100)] + [(200 + i, bad if i % 10 else good, "spam", 1, "x") for i in range(100)]
    data += [(300, bad, "one", 1, "x"), (301, good, "one", 1, "x"), (302, good, None, 1, "x"), (None, good, "fine", 1, "x"), (1, good, "fine", 1, "x"), (303, None, "fine", 1, "x"), (304, good, "", 1, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n long, host_key string").toDF("doc_id", "text", "source", "n", "host_key")
    got = host_rules.host_rules(df).collect()
    assert len(got) == len(data)
    by = {(r.host, r.base_failed): r for r in got}
    assert not by["spam", False].kept and not by["spam", False].host_kept
    assert by["fine", False].kept and not by["fine", True].kept and by["fine", True].host_kept
    assert by[None, False].kept and by["", False].kept and by[None, False].host_n == 1
    # the rates of a host are those of the prior and its counts
    hosts = Counter((r.host, r.base_failed) for r in got)
    names = {h for h, _ in hosts}
    mean, strength = brute_prior([(hosts[h, True] + hosts[h, False], hosts[h, True]) for h in names])
    for r in got:
        assert abs(r.short_rate - (hosts[r.host, True] + mean * strength) / (r.host_n + strength)) < 1e-9
        assert r.host_kept == (max(r.short_rate, r.repeated_rate, r.symbols_rate, r.lines_rate) <= host_rules.HOST_LIMIT)


def test_heavy_hosts_and_empty_tables(spark):
    text = " ".join(words(60, 1, 10_000))
    df = spark.range(4000).selectExpr("id AS doc_id", f"'{text}' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('h', id % 1500) END AS source")
    assert [r[0] for r in rows(host_rules.host_rules(df), "kept")] == [True] * 4000
    assert host_rules.host_rules(df.limit(0)).count() == 0
