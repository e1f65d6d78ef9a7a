import random

import pytest

from tests.llm.helpers import rows, words
from weftline.llm import mixture


def brute_seats(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max((v / (2 * g + 1), -i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if g < m and v > 0)
        got[-best[1]] += 1
    return got


def test_seats_equal_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        votes = [rng.choice([0, 1, 3, 3, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        most = [rng.randrange(0, 30) for _ in votes]
        seats = min(rng.randrange(0, 60), sum(m for m, v in zip(most, votes, strict=True) if v > 0))
        assert mixture.sainte_lague(votes, seats, most) == brute_seats(votes, seats, most)


def test_targets():
    got = mixture.targets([100, 10, 10, 0], [5, 2, 1, 5], 180, 2)
    assert got == pytest.approx([140, 20, 20, 0])
    assert mixture.targets([10, 10], [1, 1], 100, 2) == [20, 20]
    assert mixture.targets([], [], 0, 2) == []


def docs(spark, n=300):
    rng = random.Random(3)
    data = [(k, " ".join(words(rng.randrange(0, 400), k)), rng.choice(["b", "a", "Z", None, "é", "hot", "hot", "hot"])) for k in range(n)]
    data += [(1000, None, "a"), (1001, "", None), (1002, "tiny text", "one"), (7, data[7][1], data[7][2]), (None, "no id here", "a")]
    return spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as shard"), data


def test_mix(spark):
    df, data = docs(spark)
    got = mixture.mix(df.repartition(5), shard_words=3000).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(d or -1 for d, _, _ in data)
    sizes = {}
    for d, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mixture.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True))
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken == r.passes * r.size + sum(s.end - s.start for s in r.spans)
        assert all(0 <= s.start < s.end <= r.size for s in r.spans)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 32 * (2 + sizes[s] // 3000)
    again = mixture.mix(df.repartition(2), shard_words=3000)
    assert rows(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)


def test_areas_of_shards(spark):
    """Quotas go through areas of shards, whether a source has one of them or many."""
    df, data = docs(spark)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for area in (1, 3, 4096):
        taken, goal = {}, {}
        for r in mixture.mix(df, shard_words=2000, area=area).collect():
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source], goal[r.source] = taken.get(r.source, 0) + r.taken, r.target
        for s in goal:
            assert abs(taken[s] - goal[s]) <= 32 * (2 + sizes[s] // 2000)


def test_empty_table(spark):
    df, _ = docs(spark, 10)
    assert mixture.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixture.mix(df, max_sources=1)
