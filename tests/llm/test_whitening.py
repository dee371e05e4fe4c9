import numpy as np

from lodestar.llm.whitening import one_sided_jacobi, pivoted_cholesky, principal, whiten

SCHEMA = "vec_id long, embedding array<double>"


def covariance(size, rank, seed):
    a = np.random.default_rng(seed).standard_normal((size, rank)) * np.logspace(0, 3, rank)
    return a @ a.T


def test_cholesky_has_as_many_columns_as_the_rank():
    for size, rank in ((12, 12), (12, 5), (7, 1), (1, 1)):
        v = covariance(size, rank, 3)
        low, order = pivoted_cholesky(v)
        assert low.shape == (size, rank) and np.allclose(low @ low.T, v[order][:, order], rtol=1e-12, atol=1e-9 * v.max())
    assert pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def test_jacobi_makes_columns_orthogonal():
    for columns in (1, 2, 5, 8):
        a = np.random.default_rng(columns).standard_normal((9, columns))
        turned = one_sided_jacobi(a)
        g = turned.T @ turned
        assert np.allclose(turned @ turned.T, a @ a.T) and np.abs(g - np.diag(g.diagonal())).max() < 1e-13 * g.max()


def test_values_and_components_equal_those_of_a_library():
    for size, rank in ((16, 16), (31, 31), (20, 6)):
        v = covariance(size, rank, size)
        values, basis = principal(v)
        expected, vectors = np.linalg.eigh(v)
        assert np.allclose(values, np.maximum(expected[::-1], 0), rtol=1e-9, atol=1e-12 * values[0])
        assert np.allclose(np.abs((basis * vectors[:, ::-1]).sum(axis=0))[: min(rank, 6)], 1, atol=1e-9)
        assert (values[rank:] == 0).all() and (basis[:, rank:] == 0).all()


def expected(vectors, k):
    x = np.floor(1024 * np.array(vectors)).astype(object).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x], y @ basis / np.sqrt(values), values / (y * y).sum() * n


def test_equals_direct_computation(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((500, 12)) * np.linspace(0.1, 2, 12) + 3).tolist()
    odd = [None, [], [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [1e300] * 12, [1.0] * 5]
    rows = [(2**60 + i, x, "x", 7) for i, x in enumerate(good)] + [(None if i % 2 else i, x, "x", 7) for i, x in enumerate(odd)]
    found = whiten(spark.createDataFrame(rows, SCHEMA + ", n string, deviation int").repartition(3)).collect()
    assert len(found) == 500
    by = {r["vec_id"] - 2**60: r for r in found}
    deviations, whitened, explained = expected(good, 8)
    w = np.array([by[i]["whitened"] for i in range(500)])
    assert [by[i]["deviation"] for i in range(500)] == deviations
    signs = np.sign((w * whitened).sum(axis=0))
    assert np.allclose(w, whitened * signs, atol=1e-8) and np.allclose(by[0]["explained"], explained, rtol=1e-9)
    assert {r["identity_error"] for r in found} == {by[0]["identity_error"]} and by[0]["identity_error"] < 1e-9 and by[0]["n"] == 500


def test_few_equal_and_very_large_vectors(spark):
    one = whiten(spark.createDataFrame([(1, [2.0, 3.0])], SCHEMA)).collect()
    assert [(r["n"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], None)] and one[0]["whitened"] == [None, None]
    line = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 6.0]), (1, [3.0, 6.0])], SCHEMA)).collect()
    assert len(line) == 3 and all(abs(r["explained"][0] - 1) < 1e-12 and r["explained"][1] == 0 and r["whitened"][1] is None and r["identity_error"] < 1e-12 for r in line)
    large = whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 2.0])], SCHEMA)).collect()
    assert [r["deviation"] for r in large] == [None, None] and all(abs(abs(r["whitened"][0]) - 1) < 1e-9 for r in large)
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_query(spark, sf):
    from lodestar.llm.queries import op12_embedding_whitening

    found = op12_embedding_whitening(spark, sf).collect()
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    deviations, whitened, explained = expected([[float(c) for c in r["embedding"]] for r in rows], 8)
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    assert len(found) == 8 * len(rows)
    w = np.zeros((len(rows), 8))
    for r in found:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[at[r["vec_id"]]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-4 and r["identity_error"] < 1e-9 and r["n"] == len(rows)
    assert np.allclose(w, whitened * np.sign((w * whitened).sum(axis=0)), atol=1e-7)
