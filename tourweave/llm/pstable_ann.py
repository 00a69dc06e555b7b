"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``hashes`` functions ``floor((a.x + b) / w)`` with Gaussian
``a``.  A query visits, besides its own bucket, the buckets that differ by -1, 0 or 1 in every
function, in order of the estimated probability that a neighbour lies there: along ``a`` a
neighbour at distance ``r`` is displaced by a normal deviate of spread ``r``.  It stops when
the probabilities visited in the table reach the table's share of ``target``.  ``r`` (the
distance within which the k-th neighbour is expected) is the matching quantile of pair
distances in a bounded sample; ``w`` is ``2 r``.  The candidates of all tables are merged and
ranked by exact Euclidean distances in double precision.

Every row is indexed.  Buckets are dealt to cells of about ``cell_rows`` index rows by a hash;
a bucket larger than that is split over several cells by a hash of the id, and its visitors
visit each part.  A cell with more than ``cell_queries`` visitors is worked on in blocks of its visitors,
so no group grows with the table.  A cell returns the k nearest it has for a query, which loses nothing.  A
query with fewer than k candidates is run again over all cells, exactly.

Edge cases: vectors that are null, zero, of another length than most, or that hold null, NaN
or infinite components take no part, nor do rows with a null id; rows with the query's own id
are no candidates; repeated rows count once; ties go to the smaller id; with fewer than k
candidates in the table all are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows that the width of the buckets is fitted on; the index itself holds all rows.
SAMPLE_ROWS = 2048
#: More large buckets than this are joined, not broadcast.
BROADCAST_BUCKETS = 100_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


class Hasher:
    """The hash functions of all tables; picklable, and the same for the same seed."""

    def __init__(self, dim: int, radius: float, tables: int, hashes: int, target: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.width = 2 * radius
        self.a = rng.normal(size=(tables, dim, hashes))
        self.b = rng.uniform(0, self.width, (tables, hashes))
        # a bucket's key is a sum of random odd multiples; a collision only adds candidates
        self.mix = rng.integers(1, 1 << 62, (tables, hashes)) * 2 + 1
        self.share = 1 - (1 - target) ** (1 / tables)
        self.steps = np.array(list(product((-1, 0, 1), repeat=hashes)), np.int64)
        self.spread = radius / self.width

    def places(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, whole hash values and positions within the bucket."""
        f = (x @ self.a[t] + self.b[t]) / self.width
        h = np.floor(f)
        with np.errstate(over="ignore"):
            return (h.astype(np.int64) * self.mix[t]).sum(axis=1), h, f - h

    def keys(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.places(x, t)[0] for t in range(len(self.a))], axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The keys that one query visits, over all tables."""
        cdf = lambda z: 0.5 * (1 + erf(z / (self.spread * sqrt(2))))
        out = []
        for t in range(len(self.a)):
            key, _, inside = self.places(x[None, :], t)
            edges = [[cdf(e - f) for e in (-1, 0, 1, 2)] for f in inside[0]]
            p = np.array([[b - a, c - b, d - c] for a, b, c, d in edges])
            mass = np.prod(p[np.arange(len(p)), self.steps + 1], axis=1)
            order = np.argsort(-mass, kind="stable")
            visited = order[: int(np.searchsorted(np.cumsum(mass[order]), self.share)) + 1]
            with np.errstate(over="ignore"):
                out.append(key[0] + (self.steps[visited] * self.mix[t]).sum(axis=1))
        return np.unique(np.concatenate(out))


def expected_radius(sample: np.ndarray, k: int, rows: int) -> float:
    """The distance below which k of ``rows`` are expected, from the sample's pairs."""
    if len(sample) < 2:
        return 1.0
    square = (sample**2).sum(axis=1)
    pairs = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * sample @ sample.T))[np.triu_indices(len(sample), 1)]
    return float(max(np.quantile(pairs, min(1.0, k / max(rows, 1))), 1e-9))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2, hashes: int = 8, target: float = 0.95, cell_rows: int = 2048, cell_queries: int = 4096, seed: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows that ``is_query`` (a condition on ``vec_id``) picks."""
    schema = "query_id long, vec_id long, score double"
    rows = cut(usable(vectors, id_col, vector_col))
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    dim = len(sample[0]["v"]) if sample else 1
    hasher = Hasher(dim, expected_radius(np.array([r["v"] for r in sample]), k, count), tables, hashes, target, seed)
    cells = max(1, -(-count * tables // cell_rows))

    def vectors_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b)
            keys = hasher.keys(x)
            ids, raw = b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), ids, raw], ["key", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([hasher.probes(r) for r in x], pa.list_(pa.int64()))], ["query_id", "q", "keys"])

    indexed = rows.mapInArrow(index, "key long, vec_id long, v binary")
    large = cut(indexed.groupBy("key").count().where(F.col("count") > cell_rows).select("key", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")))
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    cell = F.pmod(F.xxhash64("key", "part"), F.lit(cells)).cast("int").alias("cell")
    dealt = indexed.join(large, "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).select(cell, "key", "vec_id", "v")
    queries = cut(rows.where(is_query).mapInArrow(probe, "query_id long, q binary, keys array<long>"))
    asking = queries.count()
    visits = queries.select("query_id", F.explode("keys").alias("key")).join(large, "key", "left")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    visits = visits.select(cell, "query_id", "key")

    def best(own: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        ids, first = np.unique(ids, return_index=True)  # in another table it is the same row
        x, other = x[first], ids != own
        ids, x = ids[other], x[other]
        score = np.sqrt(((x - q) ** 2).sum(axis=1))
        order = np.lexsort((ids, score))[:k]
        return pd.DataFrame({"query_id": np.full(len(order), own, np.int64), "vec_id": ids[order], "score": score[order]})

    def nearest(index_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(index_rows) and len(query_rows):
            index_rows = index_rows.drop_duplicates().sort_values(["key", "vec_id"], kind="stable")
            keys, ids, x = index_rows["key"].to_numpy(), index_rows["vec_id"].to_numpy(), _matrix(index_rows["v"], dim)
            for own, raw, probes in zip(query_rows["query_id"], query_rows["q"], query_rows["keys"]):
                if probes is None:
                    hit = np.arange(len(keys))
                else:
                    probes = np.asarray(probes)
                    low, high = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
                    hit = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a] or [np.empty(0, np.int64)])
                if len(hit):
                    out.append(best(own, np.frombuffer(raw), ids[hit], x[hit]))
        return pd.concat(out)

    def searched(visits: DataFrame) -> DataFrame:
        """The k nearest of each query in every cell of ``visits(cell, query_id, key)``, or of ``visits(cell, query_id, keys)`` with null for all keys."""
        asked = visits.groupBy("cell", "query_id").agg(F.collect_set("key").alias("keys")) if "key" in visits.columns else visits
        asked = asked.join(queries.select("query_id", "q").distinct(), "query_id")
        if asking <= cell_queries:  # then no cell can have more visitors
            return ranked(dealt.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(nearest, schema))
        # the lists of keys are long, so they are made again rather than kept
        crowded = cut(visits.select("cell", "query_id").distinct().groupBy("cell").count().where(F.col("count") > cell_queries).select("cell", F.ceil(F.col("count") / cell_queries).cast("int").alias("blocks")))
        crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_BUCKETS else crowded
        blocks = F.coalesce("blocks", F.lit(1))
        held = dealt.join(crowded, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        asked = asked.join(crowded, "cell", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).drop("blocks")
        group = ("cell", "block")
        return ranked(held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(nearest, schema))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = cut(searched(visits))
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = cut(queries.select("query_id").distinct().join(full, "query_id", "left_anti"))
    if count > 1 and not short.isEmpty():
        everywhere = short.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select("cell", "query_id", F.lit(None).cast("array<long>").alias("keys"))
        found = found.join(short, "query_id", "left_anti").unionByName(searched(everywhere))
    return found


def op6_pstable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
