import numpy as np
import pytest

from foliomill.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, component string"


def expected(rows, wanted=4):
    """By the full covariance matrix and exact integers: {(id, component): (n, deviation, |whitened|, explained)}."""
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(a - s / n) for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c in range(min(wanted, len(sums))):
            if values[c] > 1e-9 * values.sum():
                white = (np.array(v) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c])
                out[i, c + 1] = (n, deviation, abs(white), values[c] / values.sum())
    return out


def check(got, rows):
    want = expected(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, abs=1e-8) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_filter_finds_the_top_of_flat_and_steep_spectra():
    rng = np.random.default_rng(2)
    for values in (np.linspace(1, 0.9, 80), np.geomspace(1, 1e-9, 80), np.r_[np.ones(6), np.full(74, 0.999)], np.ones(80), np.r_[5.0, np.zeros(79)], np.zeros(80)):
        turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
        matrix = (turn * values) @ turn.T
        found, vectors, error = W.leading(lambda q, m=matrix: m @ q, 80, 4, max_rounds=8)
        assert np.allclose(found, values[:4], atol=1e-12) and error < 1e-11
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_rows_match_the_full_matrix(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 48)) @ np.diag(np.geomspace(3, 0.2, 48)) + 2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [float(c) for c in base[0]]) for i in range(300)]
    bad = [(-1, None), (-2, [None, *base[0, 1:].tolist()]), (-3, [float("nan")] * 48), (-4, [float("-inf")] * 48), (-5, [])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows + bad], SCHEMA).repartition(5)
    got = W.whiten(frame).collect()
    check(got, rows)
    one = next(r for r in got if r.vec_id == 0)
    assert {r.whitened for r in got if r.vec_id >= 1000 and r.component == 1} == {one.whitened if one.component == 1 else next(r.whitened for r in got if (r.vec_id, r.component) == (0, 1))}


def test_few_dimensions_lengths_of_their_own_and_no_variance(spark):
    rng = np.random.default_rng(6)
    flat = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.standard_normal((30, 2)))]
    line = [(100 + i, [float(i), 1.0, 1.0]) for i in range(5)]
    same = [(200 + i, [1.0] * 5) for i in range(3)]
    got = W.whiten(spark.createDataFrame([(*r, "x") for r in flat + line + same], SCHEMA)).collect()
    check([r for r in got if r.vec_id < 100], flat)
    check([r for r in got if 100 <= r.vec_id], line)
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).count() == 0 and W.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        W.whiten(empty, id_col="component")


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * (i + 1), float(i * i), -1e9 * (i % 3)]) for i in range(6)]
    got = W.whiten(spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, component string")).collect()
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values())]
    exact = {i: sum((6 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for i, d in exact.items()}
    assert any(d >= 1 << 63 for d in exact.values())


def test_equal_rows_are_projected_alike():
    rng = np.random.default_rng(3)
    onto = rng.standard_normal((48, 4))
    x = np.tile(rng.standard_normal(48), (301, 1))
    for n in (1, 2, 3, 7, 301):
        got = W._projected(x[:n], onto)
        assert (got == W._projected(x, onto)[0]).all() and np.allclose(got, x[:n] @ onto, rtol=1e-12)
