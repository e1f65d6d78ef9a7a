import random

import numpy as np

from tests.llm.helpers import rows
from weftline.llm import langid, licenses, quality

PARTS = {"aa": ["tha", "ing", "ed", "wh"], "bb": ["sch", "keit", "ü", "ei"], "cc": ["que", "ção", "os", "ñ"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize()


def lang_docs(spark, n=240):
    rng = random.Random(5)
    data = [(k, text(lang := "abc"[k % 3] * 2, rng.randrange(5, 60), rng), lang) for k in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_language(spark):
    data, df = lang_docs(spark)
    model = langid.fit(df.where("doc_id < 160"), per_language=40)
    more = spark.createDataFrame([*data[160:], (900, None, "aa"), (901, "", None), (902, "12 .. 34", "bb"), (903, "日本語", None), (904, "Keitsch " * 60000, "bb")], df.schema).selectExpr("*", "'x' as lang_pred", "1 as score", "2 as _lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(more, model).collect()}
    right = sum(got[k][0] == lang for k, _, lang in data[160:])
    assert right >= 0.97 * len(data[160:])
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] in PARTS and got[904][0] == "bb" and all(0 <= s <= 1 for _, s in got.values())
    again = langid.fit(df.where("doc_id < 160").repartition(3), per_language=40)
    assert np.allclose(again.weights, model.weights) and again.temperature == model.temperature


def test_language_windows_equal_one_by_one():
    rng = random.Random(1)
    texts = [text("abc"[k % 3] * 2, 30, rng) for k in range(20)] + [None, "", "x"]
    weights = np.random.default_rng(0).normal(size=(langid.BUCKETS + 1, 3))
    weights[-1] = 0
    each = np.array([sum(weights[b].sum(axis=0) for b in langid.buckets(langid.fold(t))) for t in texts])
    assert np.allclose(langid.text_sums(texts, weights), each)
    small = list(langid._windows(texts, 100))
    assert len(small) > 5


def test_language_without_rows(spark):
    _, df = lang_docs(spark, 6)
    model = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, model).collect()} == {"und"}
    one = langid.fit(df.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"aa"}
    assert langid.identify(df.limit(0), one).count() == 0


def quality_docs(spark, n=400):
    rng = random.Random(9)
    data = []
    for k in range(n):
        good = text("aa", rng.randrange(20, 200), rng)
        bad = [good.upper() + "!!!", " | ".join(good.split()), "spam " * 50, good.replace(" ", "*** ")][k % 4]
        data.append((k, good if k % 5 else bad, int(bool(k % 5))))
    return data, spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (3, None), (5000, 0)], "doc_id long, quality int")


def test_quality(spark):
    data, docs, labels = quality_docs(spark)
    model = quality.fit(docs, labels.where("doc_id < 300"))
    more = spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string").unionByName(docs.where("doc_id >= 300")).selectExpr("*", "'x' as score", "3 as predicted")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.rate(more, model).collect()}
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())
    right = sum(got[k][1] == q for k, _, q in data[300:])
    assert right >= 95
    assert got[1000] == got[1001]
    assert quality.rate(more.limit(0), model).count() == 0


def test_quality_without_both_labels(spark):
    _, docs, labels = quality_docs(spark, 20)
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert {r.predicted for r in quality.rate(docs, None).collect()} == {1}


def test_bradley_terry_minimum():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 3)) + [1, 0, -1], rng.normal(size=(200, 3))
    w = quality.bradley_terry(a, b, 0.01)
    loss = lambda w: np.log1p(np.exp(-(a - b) @ w)).mean() + 0.005 * w @ w
    assert all(loss(w) <= loss(w + e) for e in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3)


def test_licenses(spark):
    rng = random.Random(2)
    plain = [(k, "\n".join(text("abc"[k % 3] * 2, 12, rng) for _ in range(4))) for k in range(120)]
    marked = {
        200: (["Released under the MIT License."], "mit"),
        201: (["Licensed under the Apache License, Version 2.0."], "apache"),
        202: (["This work is licensed under the GNU General Public License, version 3."], "gpl"),
        203: (["Licensed under CC BY-NC 4.0."], "cc-by-nc"),
        204: (["Licensed under the terms of the Example Agreement."], "unknown"),
        205: (["the software", "a license to kill", "version 3", "under the sea"], ""),
    }
    docs = plain + [(k, plain[k - 200][1] + "\n" + "\n".join(v)) for k, (v, _) in marked.items()] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as licenses")
    model = licenses.fit(df)
    got = {r.doc_id: ",".join(sorted({x.family for x in r.licenses})) for r in licenses.scan_licenses(df, model).collect()}
    assert {k: got[k] for k in marked} == {k: f for k, (_, f) in marked.items()}
    assert all(got[k] == "" for k, _ in plain) and got[300] == got[301] == ""
    assert licenses.scan_licenses(df.limit(0), model).count() == 0
    assert rows(licenses.scan_licenses(df.where("doc_id = 200"), licenses.fit(df.limit(0))), "doc_id") == [(200,)]


def test_wrapped_licenses(spark):
    rng = random.Random(4)
    plain = [(k, "\n".join(text("abc"[k % 3] * 2, 12, rng) for _ in range(4))) for k in range(120)]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    narrow = lambda t, n: "\n".join(" ".join(w[i : i + n]) for w in [t.split()] for i in range(0, len(w), n))
    heads = {
        200: (gpl, [(5, "gpl")]),
        201: (gpl.replace("GNU General", "GNU Lesser General"), [(5, "lgpl")]),
        202: (gpl.replace("GNU General", "GNU Affero General"), [(5, "agpl")]),
        203: (narrow(mit, 3), [(4, "mit")]),
        204: (narrow(mit, 1), [(4, "mit")]),
        205: (narrow("Licensed under the Apache License, Version 2.0.", 4) + "\n\n" + narrow(mit, 6), [(4, "apache"), (7, "mit")]),
        206: ("this software\n\nis under\n\nthe sea of the license", []),
        207: ("Released under the MIT License.\n" + narrow(mit, 5), [(4, "mit"), (5, "mit")]),
    }
    docs = plain + [(k, plain[k - 200][1] + "\n" + v) for k, (v, _) in heads.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = licenses.fit(df.where("doc_id < 200"))
    got = {r.doc_id: [(x.line, x.family) for x in r.licenses] for r in licenses.scan_licenses(df, model).collect()}
    assert {k: got[k] for k in heads} == {k: f for k, (_, f) in heads.items()}
    assert all(got[k] == [] for k, _ in plain)
