"""SimHash near-duplicate detection with vantage-point trees.

Fingerprints
    ``A-Z`` is lower-cased, words are runs of anything but ASCII white space, shingles are
    ``width`` consecutive words joined by one space (repeats included; a text with fewer
    words is one shingle; a text without words has fingerprint 0).  A bit is 1 if it is set
    in more than half of the shingles' XXH64 values (seed 42).

Search
    All pairs of distinct fingerprints at Hamming distance ``radius`` or less, exactly:

    1. A vantage-point tree is laid out over a bounded sample of the fingerprints.  The
       sample only shapes the tree; every fingerprint is routed through it.
    2. A fingerprint's home shard is the leaf it falls into.  By the triangle inequality
       ``|d(a, v) - d(b, v)| <= d(a, b)``, so a fingerprint just outside a vantage point's
       ball is also sent, as a visitor, to the shards inside that overlap its own ball.
       Every pair meets in the home shard of at least one of the two.
    3. Each shard splits itself further by local vantage points and compares only blocks
       that the bounds cannot separate.  It returns a spanning star per local component,
       never all pairs, so a group of n copies costs n rows.
    4. Stars of all shards are merged by distributed connected components.

Edge cases: null text counts as empty; empty texts share fingerprint 0 and link like any
other; repeated rows are returned once each; a row with a null ``doc_id`` takes part but
never names a component (a component of such rows only has a null id); an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, internal, table
from .components import connected_components

SEED = 42
#: Distinct fingerprints that a shard should hold at home: the least and the most, and how many
#: shards there are between.  Visitors grow with about the root of the number of shards, so shards grow first.
SHARD_TARGET, SHARD_MOST, SHARDS = 2048, 65_536, 4096
#: The driver holds this many sampled fingerprints (8 bytes each) at most.
SAMPLE_MAX = 1 << 18
SAMPLE_PER_SHARD = 32
#: Pairs that one block comparison may cover.
BLOCK = 1 << 20
_ROWS = 1 << 16


# --- fingerprints ------------------------------------------------------------------------
def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        part = hashes[at : at + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)``, a row per row of ``docs``; ``text_key`` is the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x, width) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


# --- the vantage-point tree --------------------------------------------------------------
def hamming(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(fps: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and ball radius that split ``fps`` with few of them near the border."""
    best = None
    for v in rng.choice(fps, min(4, len(fps)), replace=False):
        d = hamming(fps, v)
        mu = int(np.median(d))
        for cut_at in (mu - 1, mu):
            inside = int((d <= cut_at).sum())
            if 0 < inside < len(fps):
                border = int(((d > cut_at - 2) & (d <= cut_at + 2)).sum())
                cost = border + abs(2 * inside - len(fps))
                if best is None or cost < best[0]:
                    best = (cost, v, cut_at)
    return best and best[1:]


class VantagePointTree:
    """Routes fingerprints to their home leaf and to the leaves that their balls overlap."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 7) -> None:
        self.radius, self.leaves = radius, 0
        rng = np.random.default_rng(seed)
        self.root = self._build(np.unique(sample), max(1, leaves), rng)

    def _build(self, fps: np.ndarray, leaves: int, rng: np.random.Generator):
        if leaves > 1 and len(fps) > 1 and (split := _vantage(fps, rng)):
            v, mu = split
            d = hamming(fps, v)
            inner, outer = fps[d <= mu], fps[d > mu]
            share = min(leaves - 1, max(1, round(leaves * len(inner) / len(fps))))
            return (v, mu, self._build(inner, share, rng), self._build(outer, leaves - share, rng))
        self.leaves += 1
        return self.leaves - 1

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(leaf, indices at home, indices that visit)`` for every leaf that gets any."""
        stack = [(self.root, np.arange(len(fps)), np.empty(0, np.int64))]
        while stack:
            node, home, visit = stack.pop()
            if not len(home) and not len(visit):
                continue
            if isinstance(node, int):
                yield node, home, visit
                continue
            v, mu, inner, outer = node
            dh, dv, r = hamming(fps[home], v).astype(np.int16), hamming(fps[visit], v).astype(np.int16), self.radius
            stack.append((inner, home[dh <= mu], np.concatenate([visit[dv <= mu + r], home[(dh > mu) & (dh <= mu + r)]])))
            stack.append((outer, home[dh > mu], visit[dv > mu - r]))


# --- exact links within one shard --------------------------------------------------------
class _Union:
    """Union-find over 0..n-1 whose unions come as arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            if not (apart := ra != rb).any():
                return
            np.minimum.at(self.root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def shard_components(fps: np.ndarray, is_home: np.ndarray, radius: int, seed: int = 11) -> np.ndarray:
    """For each fingerprint the index of the first one linked to it through this shard.

    Links between two visitors are some other shard's work, so they are not looked for.
    """
    union, rng = _Union(len(fps)), np.random.default_rng(seed)
    stack = [(np.flatnonzero(is_home), np.flatnonzero(~is_home))]
    while stack:
        home, visit = stack.pop()
        everyone = np.concatenate([home, visit])
        if not len(home) or (union.root[everyone] == union.root[everyone[0]]).all():
            continue  # nothing to find, or all of them are connected already
        split = _vantage(fps[home], rng) if len(home) * len(everyone) > BLOCK else None
        if split is None:
            step = max(1, BLOCK // len(everyone))
            for at in range(0, len(home), step):
                block = home[at : at + step]
                i, j = np.nonzero(hamming(fps[block][:, None], fps[everyone][None, :]) <= radius)
                union.add(block[i], everyone[j])
            continue
        v, mu = split
        dh, dv = hamming(fps[home], v).astype(np.int16), hamming(fps[visit], v).astype(np.int16)
        # v is one of home: whatever lies within the radius of it is one component at once
        near = np.concatenate([home[dh <= radius], visit[dv <= radius]])
        union.add(near, np.full(len(near), near[0]))
        stack.append((home[dh <= mu], np.concatenate([visit[dv <= mu + radius], home[(dh > mu) & (dh <= mu + radius)]])))
        stack.append((home[dh > mu], visit[dv > mu - radius]))
    return union.root


def links(distinct: DataFrame, radius: int = 2, shard_target: int | None = None) -> DataFrame:
    """``(u, v)``: a spanning set of the links among the distinct values of ``distinct.fp``."""
    count = distinct.count()
    shard_target = shard_target or max(SHARD_TARGET, min(SHARD_MOST, -(-count // SHARDS)))
    leaves = max(1, -(-count // shard_target))
    size = min(SAMPLE_MAX, SAMPLE_PER_SHARD * leaves)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(size) if leaves > 1 else distinct.limit(1)
    tree = VantagePointTree(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), leaves, radius)
    shipped = distinct.sparkSession.sparkContext.broadcast(tree)  # two small numbers a node, SAMPLE_MAX nodes at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for leaf, home, visit in shipped.value.route(fps):
                rows = np.concatenate([home, visit])
                columns = [np.full(len(rows), leaf, np.int32), fps[rows].view(np.int64), np.arange(len(rows)) < len(home)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "home"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        order = np.argsort(fps)  # the same stars whatever order the rows come in
        fps, home = fps[order], pdf["home"].to_numpy()[order]
        root = shard_components(fps, home, radius)
        linked = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[linked].view(np.int64), "v": fps[root[linked]].view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(join, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, shard_target: int | None = None) -> DataFrame:
    """``(doc_id, text_key, fp, component_id, root)``, a row per row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable, ``root`` names the component itself.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(distinct, radius, shard_target))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    alone = distinct.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti")
    by_fp = linked.join(firsts, "root").select("fp", "component_id", "root").unionByName(alone.select("fp", F.col("first_id").alias("component_id"), F.col("fp").alias("root")))
    return rows.join(by_fp, "fp", "left")


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one row of each component of ``found(doc_id, text_key, component_id, root)``, columns unchanged.

    The row with the component's least id stays (least ``text_key``, if several rows carry
    that id; a row without an id only where the component has no other); of rows that repeat
    both, one stays.
    """
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("copies"))
    a, b, c = internal("id"), internal("key"), internal("copies")
    kept = cut(kept.select(F.col("doc_id").alias(a), F.col("text_key").alias(b), F.col("copies").alias(c)))
    keyed = docs.withColumn(f"{b}_", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.col(f"{b}_") == F.col(b))
    once = keyed.join(kept.where(F.col(c) == 1), same, "left_semi").drop(f"{b}_")
    repeated = kept.where(F.col(c) > 1)
    if repeated.isEmpty():
        return once
    again = keyed.join(repeated, same, "left_semi").dropDuplicates([id_col, f"{b}_"]).drop(f"{b}_")
    return once.unionByName(again)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``keep_first`` leaves of each component of near fingerprints."""
    return keep_first(docs, simhash_components(docs, id_col, text_col, **options), id_col, text_col)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
