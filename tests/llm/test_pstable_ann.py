import numpy as np
import pytest
from pyspark.sql import functions as F

from tourweave.llm import pstable_ann as m


def exact(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    other = ids != q
    order = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][order].tolist(), d[other][order].tolist()))


def test_recall_and_exact_scores(spark):
    out = m.op6_pstable_ann(spark, "/root/testdata/sf0.1").toPandas()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), np.float64), e["vec_id"].to_numpy()
    found = total = 0
    for q in ids[ids % 100 == 0]:
        true = exact(x, ids, q)
        got = out[out["query_id"] == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11)) and q not in set(got["vec_id"])
        assert np.allclose(got["score"], [np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()) for v in got["vec_id"]], rtol=0, atol=1e-12)
        found += len({v for v, _ in true} & set(got["vec_id"]))
        total += 10
    assert found / total >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 8)), np.tile([1.0] * 8, (300, 1)), np.tile([1.0] * 8, (100, 1)) + rng.normal(size=(100, 8)) * 1e-6])
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), x


def test_a_bucket_of_equal_vectors_is_split_and_ties_go_to_the_smaller_id(spark, clustered):
    df, x = clustered
    out = m.search(df, F.col("vec_id").isin(400, 555, 7), cell_rows=64).toPandas()
    ids = np.arange(len(x))
    for q in (400, 555):
        got = out[out["query_id"] == q].sort_values("rank")
        assert list(zip(got["vec_id"], got["score"])) == exact(x, ids, q)
    assert len(out) == 30


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [50.0, 9.0]), (2, [-70.0, 3.0])], "vec_id long, embedding array<double>")
    out = [(r["rank"], r["vec_id"]) for r in m.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert out == [(1, 1), (2, 2)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [1.0, 2.5]), (7, [1.0, 2.5]), (None, [1.0, 2.0]), (200, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, key int, cell string")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in m.search(df, F.col("vec_id") % 100 == 0).collect())
    assert out == [(0, 1, 200, 0.0), (0, 2, 7, 0.5), (200, 1, 0, 0.0), (200, 2, 7, 0.5)]
    assert m.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_of_visitors_change_nothing(spark, clustered):
    df, _ = clustered
    rows = lambda **o: sorted(map(tuple, m.search(df, F.col("vec_id") % 5 == 0, cell_rows=64, **o).collect()))
    assert rows(cell_queries=7) == rows()
