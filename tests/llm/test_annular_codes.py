import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tourweave.llm import annular_codes as m
from tourweave.llm.common import cut

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, __x string"


def brute(rows, parts, entries, rounds):
    """The same by plain loops over whole distance tables; ``rows``: (id, vector, label), ids unique."""
    rows = sorted((r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])), key=lambda r: r[0])
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in rows], np.int64).reshape(len(rows), -1)
    cut_up = x.reshape(len(rows), parts, -1)
    books = [cut_up[:entries, p].copy() for p in range(parts)]

    def assigned():
        out = np.zeros((len(rows), parts), int)
        error = np.zeros(len(rows), int)
        for p in range(parts):
            d = ((cut_up[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
            out[:, p], error = d.argmin(axis=1), error + d.min(axis=1)
        return out, error

    for _ in range(rounds):
        chosen, _ = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = cut_up[chosen[:, p] == e, p]
                if len(own):
                    books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    chosen, error = assigned()
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    return {(r[0], bytes(c.astype(np.uint8)).hex(), int(e), by[r[2]]) for r, c, e in zip(rows, chosen, error)}, m.digest(books)


def test_annulus_finds_what_a_full_search_finds():
    rng = np.random.default_rng(3)
    for spread, width, k in ((3, 4, 64), (40, 4, 64), (200, 1, 7), (1, 2, 64), (10_000, 8, 256), (5, 4, 1)):
        entries = rng.integers(-spread, spread + 1, (k, width))
        parts = rng.integers(-spread, spread + 1, (500, width))
        index, distance, _ = m.Codebook(entries).nearest(parts)
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_ties_and_bounds_at_equal_norms():
    """All entries on one sphere, each four times, and parts at its centre: every entry is as near as any."""
    entries = np.array([[3, 4], [4, 3], [-3, 4], [5, 0], [0, -5]] * 4)
    index, distance, _ = m.Codebook(entries).nearest(np.array([[0, 0], [3, 4], [5, 0], [10, 0]]))
    assert index.tolist() == [0, 0, 3, 3] and distance.tolist() == [25, 0, 0, 25]


def test_pruning_saves_work():
    """On norms that are spread out most entries are never evaluated."""
    rng = np.random.default_rng(4)
    entries = rng.normal(size=(256, 4)) * np.linspace(1, 4000, 256)[:, None]
    parts = rng.normal(size=(1000, 4)) * rng.uniform(1, 4000, (1000, 1))
    *_, evaluated = m.Codebook(np.floor(entries).astype(int)).nearest(np.floor(parts).astype(int))
    assert evaluated < 0.45 * 256 * 1000


@pytest.mark.parametrize("rows,dim,parts,entries", [(300, 32, 16, 64), (40, 16, 16, 64), (200, 12, 4, 5), (1, 16, 16, 64)])
def test_whole_operator_by_brute_force(spark, rows, dim, parts, entries):
    rng = np.random.default_rng(rows)
    vectors = np.where(rng.random((rows, 1)) < 0.3, 0.25, rng.normal(size=(rows, dim))).astype(np.float32)  # a third are copies
    data = [(int(i), [float(c) for c in v], None if i % 5 == 0 else int(i % 3)) for i, v in zip(rng.permutation(rows * 3)[:rows], vectors)]
    coded, books = m.compress(cut(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)), parts, entries)
    expected, sha = brute(data, parts, entries, 2)
    assert {tuple(r) for r in coded.drop("label").collect()} == expected and m.digest(books) == sha


def test_labels_in_pieces(spark, monkeypatch):
    data = [(i, [float(i % 7)] * 16, None if i % 3 else i) for i in range(200)]
    frame = cut(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    one = m.compress(frame)[0].collect()
    monkeypatch.setattr(m, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, m.compress(frame)[0].fillna(-1).collect())) == sorted(tuple(-1 if c is None else c for c in r) for r in one)


def test_query_against_its_sql(spark):
    base = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{base}/embeddings.parquet'")
    expected = db.execute(m.OP13_SQL).fetchall()
    assert {tuple(r) for r in m.op13_annular_codes(spark, base).collect()} == set(expected) and expected


def test_odd_rows(spark, tmp_path):
    v = [0.5] * 16
    data = [(1, v, 1), (1, v, 1), (None, v, None), (2, None, 1), (3, [None] * 16, 1), (4, [float("nan")] * 16, 1), (5, [float("-inf")] + v[1:], 1), (6, [], 1), (7, v[:8], 2), (8, [0.0] * 16, 2), (9, [-1e30] + v[1:], 3)]
    rows = [(*r, "clash", 7, "clash") for r in data]
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    out = m.op13_annular_codes(spark, str(tmp_path / "a"))
    found = out.collect()
    assert sorted((r["vec_id"] or 0) for r in found) == [0, 1, 1, 8, 9] and all(r["error"] == 0 and r["label_error"] == 0 for r in found)
    assert out.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    assert m.op13_annular_codes(spark, str(tmp_path / "b")).count() == 0
    uneven = spark.createDataFrame([(i, [float(i)] * 5, 0) for i in range(9)], "vec_id long, embedding array<float>, label int")
    assert all(r["error"] == 0 for r in m.compress(uneven, parts=4)[0].collect())  # filled up with zeros


def test_a_sum_beyond_64_bits_is_null(spark):
    coded = spark.createDataFrame([(1 << 62,), (1 << 62,)], "error long").agg(F.try_sum("error").alias("s")).first()
    assert coded["s"] is None
