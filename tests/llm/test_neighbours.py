import numpy as np
from pyspark.sql import functions as F

from foliomill.llm import neighbours as N


def brute(rows, k):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in fine])
    ids = np.array([i for i, _ in fine])
    out = {}
    for i, v in fine:
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 16))
    x = (centres[rng.integers(0, 10, 3000)] + 0.7 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[1000:1600] = x[1000]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [None] + [1.0] * 15), (5400, [float("nan")] * 16), (5500, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in N.nearest(vectors, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute(rows[:3000], 10)
    assert set(got) == set(expected)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in expected[q]})
        for _, v, s in own:
            assert abs(s - np.sqrt(((x[v].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum())) < 1e-12
    assert hits >= 0.95 * 10 * len(expected)
    assert [v for _, v, _ in got[1200]] == list(range(1000, 1010))


def test_few_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in N.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, 5 ** 0.5)]
    assert N.nearest(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert N.nearest(vectors.limit(1), F.col("vec_id") % 100 == 0).count() == 0
