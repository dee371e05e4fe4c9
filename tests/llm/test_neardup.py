import numpy as np

from lodestar.llm.neardup import similar_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_brute_force_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        center = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 2, 12]))):
            rows.append((len(rows), (center + 0.12 * rng.standard_normal(32)).tolist(), c % 3))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, [0.0] * 32, 0), (n + 3, [float("nan")] + [1.0] * 31, 0), (n + 4, None, 0), (n + 5, [], 0), (n + 6, [None, 1.0], 0), (n + 7, [float("inf")] * 32, 0), (n + 8, [1.0, 0.0], 0), (n + 9, [2.0, 0.0], 0), rows[1]]
    found = {r["vec_id"]: r for r in similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    once = {r[0]: r for r in rows}
    assert set(found) == set(once)
    good = {i: (np.array(np.float32(r[1]), float), r[2]) for i, r in once.items() if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    links = {i: [] for i in once}
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i < j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i].append(j), links[j].append(i)
    root = {i: i for i in once}
    for _ in range(len(once)):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in once}
    assert sum(map(len, links.values())) > 50
    for i, r in found.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), root[i], root[i] == i)


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    import lodestar.llm.neardup as m

    monkeypatch.setattr(m, "BLOCK", 8)
    rng = np.random.default_rng(2)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.02 * rng.standard_normal(16)).tolist(), 1) for i in range(60)]
    found = similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(59, 0)}


def test_equal_vectors_that_are_not_finite_do_not_link(spark):
    odd = [[float("inf"), 1.0], [float("-inf"), 1.0], [float("nan"), 1.0], [0.0, -0.0], [None, 1.0]]
    rows = [(2 * i + k, x, 1) for i, x in enumerate(odd) for k in (0, 1)]
    found = similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(r["n_links"] == 0 and r["kept"] for r in found)


def test_very_large_and_very_small_vectors_link(spark):
    rows = [(i, [x, x / 2], 1) for i, x in enumerate((1e200, 3.0, 1e-200))]
    found = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(2, 0)}


def test_empty(spark):
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
