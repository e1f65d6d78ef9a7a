import random

import numpy as np

from tests.llm.helpers import components, rows, shingle_set, words
from weftline.llm import common, parity_join
from weftline.llm.graph import connected_components


def varied(text, changes, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    ok = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    part = components(len(docs), ok)
    least = {}
    for (d, _), p in zip(docs, part, strict=True):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return sorted(((d, len(s), least.get(p) if s else d) for (d, _), s, p in zip(docs, sets, part, strict=True)), key=repr)


def test_equals_brute_force(spark):
    docs, k = [], 0
    for base in range(25):
        text = " ".join(words([3, 5, 8, 9, 12, 20, 40, 80, 150, 400][base % 10], base))
        for copy in range(8):
            docs.append((k, varied(text, copy // 2, k) if copy else text))
            k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, "  \t "), (k + 3, "one"), (k + 4, "ONE"), (k + 5, docs[8][1].upper()), docs[3], (None, docs[20][1]), (None, "alone with no id at all here"), (k + 6, "É é e\u00a0f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": parity_join.F.lit(1), "cid": parity_join.F.lit("x"), "key": parity_join.F.lit(0)})
    want = brute(docs)
    assert rows(parity_join.jaccard_components(df.repartition(3)), "doc_id", "n_shingles", "component_id") == want
    assert rows(parity_join.jaccard_components(df, few=1, block=2), "doc_id", "n_shingles", "component_id") == want


def test_repeated_words_of_any_length(spark):
    docs = [(k, " ".join((cycle * 60)[first : first + n])) for k, (cycle, first, n) in enumerate((c, f, n) for c in (["ha"], ["a", "b"], ["x", "y", "z"], ["p", "q", "r", "s"], ["ha", "ho", "ha"]) for f, n in ((0, 3), (0, 5), (0, 6), (1, 7), (2, 11), (0, 50), (1, 51)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert rows(parity_join.jaccard_components(df.repartition(3)), "doc_id", "n_shingles", "component_id") == want
    assert rows(parity_join.jaccard_components(df, few=1, block=2), "doc_id", "n_shingles", "component_id") == want
    assert parity_join.near_duplicates_removed(df).count() == len({c for _, _, c in want})


def test_no_similar_pair_without_a_shared_posting():
    rng = np.random.default_rng(3)
    for n in (4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 40, 63, 64, 100, 257, 500, 1030):
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            most = n // 9 * 2
            gone = int(rng.integers(0, max(1, n // 5) + 1))
            new = int(rng.integers(0, max(1, most) + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**63, new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert parity_join.may_link(len(a), parity_join.sketch(a), len(b), parity_join.sketch(b))
                meet = 0
                for spare, x in parity_join.postings(a):
                    for other, y in parity_join.postings(b):
                        common = np.intersect1d(x, y)
                        meet += len(common) > 0
                        assert not len(common) or spare == other
                assert meet


def test_long_texts_in_steps():
    w = [x.encode() for x in words(1000, 1)]
    assert (parity_join.shingles(w, step=70) == parity_join.shingles(w)).all()


def test_empty_table_and_stage(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert parity_join.jaccard_components(none).count() == 0
    text = " ".join(words(50, 1))
    docs = spark.createDataFrame([(5, text, "a"), (2, text + " more", "b"), (5, text, "a"), (9, "other words", "c"), (10, None, "c")], "doc_id long, text string, source string")
    assert rows(parity_join.near_duplicates_removed(docs), "doc_id") == [(10,), (2,), (9,)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_that_share_a_name(spark):
    docs = [(k, " ".join(words(30, k // 2))) for k in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(parity_join.jaccard_components(df, class_bits=2), "doc_id", "n_shingles", "component_id") == brute(docs)


def test_candidates_of_a_large_group_grow_with_its_rows(spark):
    base = " ".join(words(120, 1, 5000))
    docs = [(k, varied(base, 3, k)) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    keep = parity_join._links
    try:
        parity_join._links = lambda named, *rest: (seen.append(named.count()), keep(named, *rest))[1]
        got = rows(parity_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    finally:
        parity_join._links = keep
    assert got == brute(docs)
    assert sum(seen) < 30 * len(docs)  # 180,000 pairs


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2)], "doc_id long, text string, _row_key string, copies int")
    got = parity_join.near_duplicates_removed(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", "x", 1)]


def test_star_blocks_are_bounded_by_size(spark):
    """512 near copies of a long text: blocks hold no more shingles than most, and no link is lost."""
    base = " ".join(words(3000, 1, 50_000))
    docs = [(k, varied(base, 20, k)) for k in range(512)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(df, most=100_000).collect()}
    assert got == dict.fromkeys(range(512), 0)


def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    text = " ".join(words(50, 1))
    docs = spark.createDataFrame([(5, text), (2, text + " more"), (9, "other words")], "doc_id long, text string")
    got = parity_join.jaccard_components(docs)
    assert len(list(tmp_path.glob("weftline-*"))) == 2 and rows(got, "doc_id", "component_id") == [(2, 2), (5, 2), (9, 9)]
