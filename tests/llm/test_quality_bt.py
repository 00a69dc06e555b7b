import random

import numpy as np
from pyspark.sql import functions as F

from tourweave.llm import quality_bt as m


def test_fit_ranks_and_cuts_at_the_share_of_bad():
    rng = np.random.default_rng(1)
    good = rng.random(2000) < 0.8
    x = rng.normal(size=(2000, 4))
    x[:, 1] += 3 * good
    w, at = m.fit(x, good)
    worth = x @ w
    assert worth[good].mean() > worth[~good].mean()
    assert abs((worth < at).mean() - (~good).mean()) < 0.01
    assert ((worth >= at) == good).mean() > 0.85


def test_one_kind_of_label_only():
    w, at = m.fit(np.ones((5, 3)), np.ones(5, bool))
    assert not w.any() and at == 0
    w, at = m.fit(np.empty((0, 3)), np.empty(0, bool))
    assert not w.any() and at == 0


def test_held_out_accuracy(spark):
    out = m.op5_quality_bradley_terry(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert out.count() == 1000 and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_labels_that_are_held_out_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("fine words in a row " * (i % 9 + 1)) if i % 3 else "###$$$ %%% " * (i % 5 + 1)) for i in range(120)], "doc_id long, text string")
    labels = spark.range(120).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(m.admitted(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted(map(tuple, m.score(docs, x, m.admitted()).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 9), (1, 1, 9), (4, 0, 9), (None, 0, 9), (6, None, 9), (7, 1, 9), (99, 1, 9)], "doc_id long, quality int, score int")
    rows = m.score(odd_docs, labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    kept = m.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert m.score(no_docs, labels).count() == 0
    none = m.score(odd_docs, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    random.seed(0)


def test_fit_by_plain_gradient_descent():
    """Another optimiser on the same pairs finds the same weights and the same cut."""
    rng = np.random.default_rng(3)
    good = rng.random(400) < 0.6
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + good[:, None] * [0.7, -2.0, 0.0]
    w, at = m.fit(x, good, seed=4)
    draw = np.random.default_rng(4)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pairs = m.PAIRS_EACH * min(len(winners), len(losers))
    d = z[draw.choice(winners, pairs)] - z[draw.choice(losers, pairs)]
    v = np.zeros(3)
    for _ in range(4000):
        v -= 0.5 * (-(d / (1 + np.exp(d @ v))[:, None]).mean(axis=0) + m.RIDGE * v)
    assert np.allclose(w, v / x.std(axis=0), atol=1e-5)
    worth = np.sort(x @ w)
    assert abs(at - np.quantile(worth, (~good).mean())) < 1e-9


def test_scores_outside_spark(spark):
    """The query's scores, recomputed from the texts and labels with NumPy alone."""
    import math
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    remainder = {i: zlib.crc32(str(i).encode()) % 3 for i in docs}
    learned = [i for i in docs if i in labels and labels[i] is not None and remainder[i] != 1]
    order = spark.createDataFrame([(i,) for i in learned], "doc_id long").orderBy(F.xxhash64("doc_id")).collect()
    learned = [r["doc_id"] for r in order]
    x = np.array([m.statistics(docs[i].encode()) for i in learned])
    w, at = m.fit(x, np.array([labels[i] > 0 for i in learned]))
    for r in m.op5_quality_bradley_terry(spark, sf).collect():
        score = 1 / (1 + math.exp(at - float(np.dot(m.statistics(docs[r["doc_id"]].encode()), w))))
        assert abs(r["score"] - score) < 1e-9 and r["held_out"] == (remainder[r["doc_id"]] == 1) and r["predicted"] == (r["score"] >= 0.5)
