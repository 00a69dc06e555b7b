"""Quality scores by Bradley-Terry pairwise ranking.

A document's worth is a linear function of text statistics.  Each preference pair (a document
labelled good over one labelled bad) adds the logistic loss of the difference of their
features; the weights minimise the mean loss plus a small ridge, by Newton steps.  The cut is
a quantile of the training documents' worths: the share of bad labels among them.  The score
is the logistic function of worth less cut, so a score of 0.5 is exactly the cut.

Labels are used of the rows that ``train`` admits, at most ``MAX_LABELLED`` of them (those of
least id hash, a fixed bound of the fit; every document is scored).  Only text statistics
enter a score.

Edge cases: null text counts as empty; empty texts get a score like any other; repeated rows
are returned once each; labels that repeat or contradict each other all count; null labels
do not; without both kinds of label every document scores 0.5; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, internal, table, text_or_empty

#: Labelled rows that the fit may use, and pairs drawn for each row of the rarer label.
MAX_LABELLED = 40_000
PAIRS_EACH = 40
RIDGE = 1e-3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "bangs", "pipes", "marks", "stops", "other_punctuation", "beyond_ascii",
    "line_length", "distinct_words", "repeated_lines", "repeated_triples", "short_words", "ends_in_mark",
)
_MARKS = b"#$%&*@^~_=+<>\\/{}[]"
_MARK_STR = _MARKS.decode()


def statistics(text: bytes) -> list[float]:
    """The features of one UTF-8 text; all are shares or logarithms, so length alone does not rule."""
    n = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = set(zip(words, words[1:], words[2:]))
    punctuation = sum(int(seen[c]) for c in b"\"'(),-:;?`")
    return [
        float(np.log1p(len(words))),
        float(np.log1p((n - int(seen[32])) / m)),
        int(seen[65:91].sum()) / n,
        int(seen[48:58].sum()) / n,
        int(seen[33]) / n,
        int(seen[124]) / n,
        sum(int(seen[c]) for c in _MARKS) / n,
        int(seen[46]) / n,
        punctuation / n,
        int(seen[128:].sum()) / n,
        float(np.log1p(n / max(1, len(lines)))),
        len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(triples) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        sum(len(w) <= 3 for w in words) / m,
        sum(w[-1] in _MARKS or w[-1] == 33 for w in words) / m,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, features)``, a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([statistics(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), found], ["doc_id", "text_key", "features"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, features array<double>")


def fit(x: np.ndarray, good: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights on the raw features, and the cut."""
    if not good.any() or good.all():
        return np.zeros(x.shape[1]), 0.0
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - x.mean(axis=0)) / scale
    rng = np.random.default_rng(seed)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = PAIRS_EACH * min(len(winners), len(losers))
    d = z[rng.choice(winners, pairs)] - z[rng.choice(losers, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = -(d * (1 - p)[:, None]).mean(axis=0) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.abs(step).max()))
        if float(np.abs(step).max()) < 1e-6:
            break
    w /= scale
    worth = x @ w
    return w, float(np.quantile(worth, 1 - good.mean()))


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(doc_id, text_key, score, predicted)``, a row per row of ``docs``.

    ``train`` is a condition on ``doc_id`` that labelled rows must meet to be learned from.
    """
    rows = cut(features(docs, id_col, text_col))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    known = known if train is None else known.where(train)
    sample = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key", "y").limit(MAX_LABELLED).select("features", "y").toPandas()
    x = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    w, at = fit(x, sample["y"].to_numpy() > 0)
    worth = F.lit(-at)
    for i, c in enumerate(w):
        worth = worth + F.element_at("features", i + 1) * F.lit(float(c))
    scored = rows.select("doc_id", "text_key", (1 / (1 + F.exp(-worth))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, columns unchanged."""
    a, b = internal("id"), internal("key")
    bad = cut(score(docs, labels, train, id_col, text_col).where("predicted = 0").select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct())
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text_or_empty(text_col)) == F.col(b))
    return docs.join(bad, same, "left_anti")


def admitted() -> Column:
    return crc_remainder(F.col("doc_id"), 3) != 1


def op5_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), admitted())
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
