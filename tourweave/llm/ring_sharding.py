"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` positions on a ring of 64-bit hashes.  A key belongs to the arc
that ends at the next virtual node clockwise.  Shards have capacities; the keys of an arc
that find its shard full continue clockwise to the next shard with room.  All arcs advance
together, one virtual node a round, and share the room of a shard in ring order, so the
keys of a shard depend on the keys and the capacities alone, not on the order of the rows; only
which of the rows that repeat a key gets which of its places depends on where they stand.

Only the number of keys per arc (``shards * vnodes`` numbers at most, whatever the data)
reaches the driver, which turns it into rank intervals per arc.  Ranks within an arc are
distributed: rows of one key are numbered within their partition, keys by running sums of
counts, first over ranges of hashes (``2 ** RANGE_BITS`` at most), then within a range, so that no
task gathers the rows of a hot key or of an arc.

``epsilon`` sets the capacities to ``ceil((1 + epsilon) * rows / shards)``; without it they
are the exact share, so that the row counts of two shards differ by one at most.

Edge cases: null text has size 1 and the checksum of the empty text; null ids are one key;
repeated rows get slots of their own; an empty table gives an empty result; other columns
of the input pass through ``assign``, which replaces columns named ``shard`` and ``slot``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, internal, table

RANGE_BITS = 20


class Ring:
    """The virtual nodes of ``shards`` shards in order of their signed 64-bit positions."""

    def __init__(self, shards: int, vnodes: int = 64) -> None:
        if shards < 1 or vnodes < 1:
            raise ValueError("a ring needs shards and virtual nodes")
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        nodes = sorted((signed(xxhash.xxh64_intdigest(f"{s}/{v}")), s) for s in range(shards) for v in range(vnodes))
        self.count = shards
        self.positions, self.shards = [p for p, _ in nodes], [s for _, s in nodes]

    def arc(self, position: int) -> int:
        """The index of the virtual node that ends the arc of ``position``."""
        return (bisect_right(self.positions, position - 1)) % len(self.positions)


def exact_capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flows(counts: dict[int, int], ring: Ring, capacities: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, from rank, to rank, shard, first slot)`` for all keys; ranks and slots from 0."""
    if sum(counts.values()) > sum(capacities):
        raise ValueError("the capacities don't hold all keys")
    used, out, tried = [0] * ring.count, [], {arc: set() for arc in counts}
    waiting = {arc: (0, n) for arc, n in sorted(counts.items()) if n}
    hop = 0
    while waiting:
        for arc, (done, n) in list(waiting.items()):
            shard = ring.shards[(arc + hop) % len(ring.shards)]
            if shard in tried[arc]:
                continue
            tried[arc].add(shard)
            if take := min(n - done, capacities[shard] - used[shard]):
                out.append((arc, done, done + take, shard, used[shard]))
                used[shard] += take
                waiting[arc] = (done + take, n)
            if waiting[arc][0] == n:
                del waiting[arc]
        hop += 1
    return out


def assign(keys: DataFrame, shards: int, vnodes: int = 64, epsilon: float | None = None, key_col: str = "key") -> DataFrame:
    """``keys`` with ``shard`` and ``slot`` (gapless from 0 within each shard); ``keys`` is read once."""
    ring = Ring(shards, vnodes)
    positions = np.array(ring.positions, np.int64)
    h, row, arc, part, span, rank, before, n, lo, hi, base, to = (internal(x) for x in ("h", "row", "arc", "part", "span", "rank", "before", "n", "lo", "hi", "base", "to"))
    kept = [c for c in keys.columns if c not in ("shard", "slot")]

    @F.pandas_udf("int")
    def arc_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, values.to_numpy()) % len(positions)).astype("int32")

    placed = keys.withColumn(h, F.xxhash64(F.col(key_col))).select(*kept, h, F.monotonically_increasing_id().alias(row))
    placed = cut(placed.withColumn(arc, arc_of(h)).withColumn(part, F.shiftright(row, 33)).withColumn(span, F.shiftright(h, 64 - RANGE_BITS)))
    counts = {r[arc]: r["count"] for r in placed.groupBy(arc).count().collect()}
    rows = sum(counts.values())
    capacities = exact_capacities(rows, shards) if epsilon is None else [int(np.ceil((1 + epsilon) * rows / shards))] * shards
    schema = T.StructType([T.StructField(x, T.IntegerType() if x in (arc, to) else T.LongType()) for x in (arc, lo, hi, to, base)])
    plan = keys.sparkSession.createDataFrame(flows(counts, ring, capacities), schema)

    def preceding(group: list[str], order: list[str]) -> Column:
        return F.sum(n).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)

    groups = placed.groupBy(arc, span, h, part).agg(F.count("*").alias(n))
    spans = placed.groupBy(arc, span).agg(F.count("*").alias(n))
    spans = spans.select(F.col(arc), F.col(span), preceding([arc], [span]).alias(base))
    groups = groups.select(arc, span, h, part, preceding([arc, span], [h, part]).alias(before)).join(spans, [arc, span])
    groups = groups.select(arc, h, part, (F.col(before) + F.col(base)).alias(before))
    within = F.row_number().over(Window.partitionBy(arc, h, part).orderBy(row)) - 1
    ranked = placed.withColumn(rank, within).join(groups, [arc, h, part]).withColumn(rank, F.col(before) + F.col(rank))
    hit = (ranked[arc] == plan[arc]) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi))
    return ranked.join(F.broadcast(plan), hit).select(*kept, F.col(to).alias("shard"), (F.col(base) + F.col(rank) - F.col(lo)).alias("slot"))


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(keys, 16, key_col="doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
