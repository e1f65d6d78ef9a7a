import random

import corpus_pipeline
from tests.llm.helpers import words


def planted(spark, path):
    """A small corpus: clean texts, junk, copies, near copies and benchmark passages; labels and benchmark."""
    rng = random.Random(8)
    sound = ["tha", "ing", "ed", "whe", "on", "er", "ly"]
    text = lambda n: " ".join("".join(rng.choice(sound) for _ in range(rng.randrange(2, 5))) for _ in range(n)).capitalize() + "."
    clean = {k: text(rng.randrange(60, 200)) for k in range(120)}
    junk = {200 + k: (text(80).upper().replace(" ", "!! ") + "!!") for k in range(40)}
    items = {k: " ".join(words(40, 500 + k)) for k in range(3)}
    copies = {300: clean[3], 301: clean[3].upper().lower(), 302: clean[4] + " one more", 303: clean[5]}
    dirty = {400 + k: items[k] + " " + text(20) for k in range(3)}
    docs = {**clean, **junk, **copies, **dirty}
    rows = [(k, t, "en" if k % 2 else "xx", f"s{k % 4}", len(t)) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k in clean), 0) for k in [*clean, *junk] if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean, junk, dirty


def test_stages(spark, tmp_path):
    clean, junk, dirty = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(kept["quality"] & set(junk)) <= 2 and len(set(clean) - kept["quality"]) <= 3
    assert kept["near_duplicates"] == {k for k in kept["language"] if k < 300 or k >= 400}
    assert kept["benchmark"] == kept["near_duplicates"] - set(dirty)
    assert kept["mixture"] == kept["benchmark"]
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.taken for r in docs.collect()}


def test_odd_rows_and_columns(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s1", 0), (None, None, None, None, None)], docs.schema)
    odd = docs.unionByName(more).unionByName(docs.where("doc_id = 7")).selectExpr("*", "7.0 as score", "'kept' as predicted", "1 as lang_pred", "2 as _text", "3 as _spans", "4 as _row_key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns, name
        found = got.collect()
        assert {(r.score, r.predicted, r.lang_pred, r._text, r._spans, r._row_key) for r in found} == {(7.0, "kept", 1, 2, 3, 4)}
        assert sum(r.doc_id == 7 for r in found) == (1 if name == "near_duplicates" else 2)
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() == odd.count()
