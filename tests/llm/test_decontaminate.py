import hashlib
import random
import re

from tests.llm.helpers import rows, words
from weftline.llm import decontaminate as dc


def norm(t):
    return re.findall(dc.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = norm(t), set(), set()
        for i, it in items:
            v = norm(it)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    if i is not None:
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(4)
    items = [(k, " ".join(words(n, k, 30))) for k, n in enumerate((40, 20, 13, 12, 7, 3, 14, 60, 13))] + [(20, None), (21, " , "), (22, "Été-w1"), (None, " ".join(words(15, 99, 30)))]
    docs = []
    for k in range(80):
        w = words(rng.randrange(0, 120), 1000 + k, 30)
        for _ in range(rng.randrange(3)):
            v = (items[rng.randrange(9)][1]).split()
            a = rng.randrange(len(v))
            w[rng.randrange(len(w) + 1) : 0] = v[a : a + rng.randrange(1, 30)]
        docs.append((k, ", ".join(w).upper()))
    return docs + [(100, None), (101, ""), (102, "été w1"), (103, items[0][1]), (103, items[0][1]), (None, items[1][1])], items


def test_equals_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as items", "0 as _spans")
    i = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute(docs, items)
    assert rows(dc.contamination_report(d, i), *columns) == want
    assert rows(dc.contamination_report(d, i, shard_words=30), *columns) == want  # several shards


def test_one_word_items(spark):
    docs, items = [(1, "a b a"), (2, "a"), (3, "b c")], [(1, "a"), (2, "b c")]
    got = rows(dc.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute(docs, items)


def test_removal_and_empty_tables(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in brute(docs, items) if r[5]}
    assert {r.doc_id for r in dc.decontaminate(d, i).collect()} == {k for k, _ in docs} - bad
    long = " ".join([*words(1000, 5), *items[0][1].split()[:20], "end"])
    cut = dc.decontaminate(spark.createDataFrame([(1, long)], "doc_id long, text string"), i, cut=True).first().text
    assert cut == " ".join([*words(1000, 5), "end"])
    assert dc.contamination_report(d, i.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert dc.contamination_report(d.limit(0), i).count() == 0


def test_all_columns_stay(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _spans", "2 as _spans_0", "3 as __spans_1", "4 as _n_words")
    i = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[0] for r in brute(docs, items) if r[5]}
    for options in ({}, {"shard_words": 30}, {"cut": True}):
        kept = dc.decontaminate(d, i, **options)
        assert kept.columns == d.columns
        assert {tuple(r)[:1] + tuple(r)[2:] for r in kept.collect()} == {(k, 1, 2, 3, 4) for k, _ in docs if k not in bad}
    assert {r["_spans_0"] for r in dc.find_spans(d, i, shard_words=30).collect()} == {2}
