import numpy as np

from tests.llm.helpers import components, rows
from weftline.llm.vector_join import near_vectors


def case():
    rng = np.random.default_rng(2)
    out = []
    for base in rng.normal(size=(30, 16)):
        for k in range(4):
            v = base + rng.normal(size=16) * [0, 0.1, 0.2, 0.4][k]
            out.append([float(np.float32(x)) for x in v * (k + 1)])
    out += [out[0], out[0], out[5], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    return list(enumerate(out))


def brute(data):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = data[i][1], data[j][1]
        if not sound(a) or not sound(b) or len(a) != len(b):
            return False
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.95

    part = components(len(data), linked)
    least = {p: min(data[i][0] for i in range(len(data)) if part[i] == p) for p in part}
    return sorted(((d, sum(linked(i, j) for j in range(len(data)) if j != i), least[part[i]], d == least[part[i]]) for i, (d, _) in enumerate(data)), key=repr)


def test_equals_brute_force(spark):
    data = case()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as cell", "3 as dim")
    for block in (2048, 7):  # whole cells, and cells of many blocks
        assert rows(near_vectors(df.repartition(3), block=block), "vec_id", "n_links", "component_id", "kept") == brute(data)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_ids_and_heavy_classes(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8).tolist()
    data = [(k, base) for k in range(900)] + [(None, base)] + [(1000 + k, rng.normal(size=8).tolist()) for k in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as cid", "3 as part")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert len(got) == len(data)
    assert all(got[k][1] == 0 and got[k][0] >= 900 and got[k][2] == (k == 0) for k in range(900)) and got[None][:2] == got[5][:2] and not got[None][2]
