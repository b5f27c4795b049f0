import numpy as np
import pytest

from graphloom.llm.whiten import lobpcg, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, part string, x double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "p", 0.5) for i, v in vectors], SCHEMA)


def brute(vectors):
    """{row: values} by a dense eigendecomposition and whole-number sums."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x], float)
    values, turn = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], turn[:, ::-1]


def check(found, vectors, dims):
    n, deviation, y, values, turn = brute(vectors)
    k = min(32, dims)
    assert len(found) == n * k
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    explained = {r.component: r.explained for r in found}
    assert np.allclose([explained[c] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    for c in range(1, k + 1):
        mine = np.sort([r.whitened for r in found if r.component == c])
        w = y @ turn[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - np.sort(w)).max(), np.abs(mine - np.sort(-w)).max()) < 1e-7


@pytest.mark.parametrize("dims", [3, 40, 130])
def test_equals_a_dense_decomposition(spark, dims):
    rng = np.random.default_rng(dims)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((300, dims)) * np.linspace(0.2, 3, dims))]
    data += [data[5], data[5], (None, data[7][1])]
    odd = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [1.0] * (dims + 1)), (906, [1e30] * dims)]
    found = whiten(frame(spark, data + odd)).collect()
    assert sum(r.vec_id is None for r in found) == min(32, dims) and not {r.vec_id for r in found} & set(range(900, 907))
    check(found, [v for _, v in data], dims)


def test_components_without_variance_have_no_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(c) for c in rng.standard_normal(2)] + [7.0, 0.0]) for i in range(50)]
    assert {r.component for r in whiten(frame(spark, data)).collect()} == {1, 2}
    few = whiten(frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 0.0, 1.0])])).collect()
    assert {r.component for r in few} == {1} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in few)


def test_equal_vectors_and_empty_tables_give_nothing(spark):
    assert whiten(frame(spark, [(i, [0.5, -0.5]) for i in range(5)])).collect() == []
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_deviations_beyond_64_bits_are_null(spark):
    large = float(2**40)
    found = whiten(frame(spark, [(1, [large, 0.0]), (2, [-large, 1.0]), (3, [0.0, 3.0])])).collect()
    assert {r.vec_id: r.deviation for r in found} == {1: None, 2: None, 3: (3 * 192 - 256) ** 2}


def test_residuals_are_certified_or_it_fails():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 400)) * np.linspace(1, 5, 400)
    v = a.T @ a / 2000
    values, vectors, worst = lobpcg(lambda b: v @ b, 400, 32, np.trace(v))
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * np.trace(v) and worst <= 1e-13 * np.trace(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:32], rtol=1e-12)
    with pytest.raises(ArithmeticError):
        lobpcg(lambda b: v @ b, 400, 32, np.trace(v), most_rounds=2)
