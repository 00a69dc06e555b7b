import numpy as np
import pytest

from tourweave.llm import jacobi_whitening as m

VECTORS = "vec_id long, embedding array<float>, component int, n string, __x string"


def whole(vectors):
    return np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 0


def test_rounds_cover_each_pair_once():
    for size in (1, 2, 3, 4, 7, 10):
        rounds = m.pairs_by_turns(size) if size > 1 else []
        drawn = [(int(a), int(b)) for p, q in rounds for a, b in zip(p, q)]
        assert sorted(drawn) == [(a, b) for a in range(size) for b in range(a + 1, size)]
        assert all(len({*p.tolist(), *q.tolist()}) == 2 * len(p) for p, q in rounds)


def test_jacobi_against_numpy():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 64):
        a = rng.normal(size=(3 * size, size))
        a = a.T @ a
        values, vectors = m.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * values[0]) and np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)


def test_small_eigenvalues_keep_their_digits():
    """Of a scaled well-conditioned matrix even eigenvalues far below rounding of the largest are right."""
    scale = np.diag(10.0 ** -np.arange(0, 20, 4))
    core = np.eye(5) + 0.1
    values, _ = m.jacobi(scale @ core @ scale)
    # by exact arithmetic on fractions: the determinant is the product of the eigenvalues
    determinant = np.prod(np.diag(scale)) ** 2 * np.linalg.det(core)
    assert np.isclose(np.prod(values), determinant, rtol=1e-12) and values[-1] < 1e-30
    assert np.isclose(values[0], np.linalg.eigvalsh(scale @ core @ scale)[-1], rtol=1e-12)


def test_degenerate_matrices():
    assert m.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    values, vectors = m.jacobi(np.ones((4, 4)))
    assert np.allclose(values, [4, 0, 0, 0]) and np.allclose(np.abs(vectors[:, 0]), 0.5)
    assert m.jacobi(np.zeros((0, 0)))[0].size == 0


@pytest.mark.parametrize("rows,dim", [(400, 16), (30, 5), (3, 8)])
def test_whole_operator_by_brute_force(spark, rows, dim):
    rng = np.random.default_rng(rows)
    vectors = (rng.normal(size=(rows, dim)) * np.linspace(3, 0.2, dim) + 5).astype(np.float32)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], rows // 2, axis=0)])  # one common vector, which counts once
    data = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    out = m.whiten(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)).toPandas()
    x = whole(vectors)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    rank = min(4, n - 1)
    assert len(out) == 4 * len(data) and set(out["n"]) == {n}
    deviation = {i: sum(int(n * a - b) ** 2 for a, b in zip(v, total)) for i, v in enumerate(x)}
    assert all(deviation[r.vec_id] == r.deviation for r in out.itertuples())
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()[:, :rank]
    assert np.allclose(np.abs(wide), np.abs((x - total / n) @ u[:, :rank] / np.sqrt(e[:rank])), atol=1e-8)
    explained = out.drop_duplicates("component").set_index("component")["explained"]
    assert all(np.isclose(explained[k + 1], e[k] / e.sum(), rtol=1e-9) for k in range(rank))
    assert set(out[out.component > rank]["whitened"]) <= {0.0} and out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_squares_beyond_64_bits():
    w = m.Whitening(1 << 34, np.array([0, 5]), np.zeros(2), np.zeros((2, 1)))
    x = np.array([[1 << 20, 3], [0, 1]])
    assert w.squares(x) == [None, (((1 << 34) - 5) ** 2) if ((1 << 34) - 5) ** 2 < 1 << 63 else None]
    v = m.Whitening(1 << 60, np.array([1 << 40]), np.zeros(1), np.zeros((1, 1)))
    assert v.deviations(np.array([[7]])).tolist() == [[(7 << 60) - (1 << 40)]]


def test_odd_rows(spark, tmp_path):
    v = [0.5, 1.0, -1.0]
    data = [(1, v), (1, v), (None, [1.0, 2.0, 3.0]), (2, None), (3, [None, 1.0, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, []), (7, [1.0]), (8, [0.0, -0.0, 0.0])]
    spark.createDataFrame([(*r, 7, "clash", "clash") for r in data], VECTORS).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    out = m.op12_jacobi_whitening(spark, str(tmp_path / "a")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted((i, c) for i in (0, 1, 1, 8) for c in (1, 2, 3))
    assert all(r["n"] == 3 and np.isfinite(r["whitened"]) for r in out) and all(r["whitened"] == 0 and r["explained"] == 0 for r in out if r["component"] == 3)
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    assert m.op12_jacobi_whitening(spark, str(tmp_path / "b")).count() == 0
    spark.createDataFrame([(1, v), (2, v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "c" / "embeddings.parquet"))
    one = m.op12_jacobi_whitening(spark, str(tmp_path / "c")).collect()
    assert len(one) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, 0.0, 0.0, 0.0) for r in one)
