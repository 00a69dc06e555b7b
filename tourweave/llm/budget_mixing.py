"""Mixing sources to target weights by subset sums over document lengths.

The mix has ``share`` times the words of the corpus.  Sources, in order of their code points (null last), have weights
that repeat; a source's target is its weight's part of the budget, at most ``most`` times its own words, and what that
cuts off is shared anew among the others until none is above.  Sources are a table, and every round of
sharing is one aggregate over it.

A source whose target is ``w`` times its words and a rest takes each document ``w`` times, and some once more, so that
their words come nearest to the rest.  Which ones is decided on its lengths: documents are counted by exact
length, most of the rest is filled by a seeded draw of lengths in proportion to their counts, and the remaining
budget (``WINDOW`` words or so, of which there are always many ways to choose) by dynamic programming over bounded counts.  A
source's lengths are one group; different lengths add up, so a source of 1e12 words has 1.4e6 of them at most.

Then each length has a number of documents to give: those with the smallest seeded hashes of id and text.  A length
may hold a third of all rows, so the hashes are counted by their leading bits, which gives the one range of hashes
in which the limit lies; only rows of that range are ranked, first by counts of a hash within a partition, and so
rows that repeat an id and a text are never gathered.

Edge cases: null text has no words and is taken 0 words; null ids are one id; repeated rows are documents of their own;
a source without words has target 0; where all documents are longer than the rest, the nearest of none and the
shortest is taken; an empty table gives an empty result; other columns pass if named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, internal, table

WEIGHTS = (3, 1, 2)
#: Words that are left to dynamic programming.
WINDOW = 1 << 15
#: Rows of one range of hashes, about; and the leading bits that ranges may have.
RANGE_ROWS, RANGE_BITS = 1 << 15, 24
#: More pairs of source and length than this are joined, in ``SALTS`` pieces each, not broadcast.
BROADCAST_LENGTHS = 200_000
SALTS = 16


def nearest_sum(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, ``counts`` at most, so that the sum is nearest to ``budget`` (the lower of two).

    Dynamic programming over the sums up to twice the budget (none beyond is nearer than 0): a sum keeps the bundle
    (a length some number of times) that first reached it.  Time is sums x lengths x log counts, memory the sums.
    """
    taken = [0] * len(lengths)
    usable = [i for i, (length, count) in enumerate(zip(lengths, counts)) if length > 0 and count > 0]
    if budget <= 0 or not usable:
        return taken
    top = 2 * budget
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    by = np.full(top + 1, -1, np.int32)
    bundles: list[tuple[int, int]] = []
    for i in usable:
        left, size = min(counts[i], top // lengths[i]), 1
        while left > 0 and not reached[budget]:
            size = min(size, left)
            step = size * lengths[i]
            new = ~reached[step:] & reached[: top + 1 - step]
            by[step:][new] = len(bundles)
            reached[step:] |= new
            bundles.append((i, size))
            left, size = left - size, size * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(min(sums, key=lambda s: (abs(int(s) - budget), s)))
    while at:
        i, size = bundles[by[at]]
        taken[i] += size
        at -= size * lengths[i]
    return taken


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take once (more), for about ``budget`` words; the same for the same seed."""
    key = lambda i: xxhash.xxh64_intdigest(f"{seed}/{lengths[i]}")
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=key)
    words = sum(lengths[i] * counts[i] for i in order)
    if budget >= words:
        return [c if n > 0 else 0 for n, c in zip(lengths, counts)]
    taken = [0] * len(lengths)
    drawn = max(0, budget - window // 2)  # so much in proportion; each length's share is rounded up or down as the running sum is
    before = rest = 0
    for i in order:
        upto = before + counts[i]
        taken[i] = upto * drawn // words - before * drawn // words
        before = upto
    rest = budget - sum(t * n for t, n in zip(taken, lengths))
    for i in order:  # the draw may have hit many long documents
        if rest >= 0:
            break
        back = min(taken[i], -(rest // lengths[i]))
        taken[i], rest = taken[i] - back, rest + back * lengths[i]
    for i in order:  # or too few
        if rest <= window:
            break
        more = min(counts[i] - taken[i], (rest - window // 2) // lengths[i])
        taken[i], rest = taken[i] + more, rest - more * lengths[i]
    left = [counts[i] - taken[i] for i in order]
    for i, more in zip(order, nearest_sum([lengths[i] for i in order], left, rest)):
        taken[i] += more
    return taken


def ranked_sources(sized: DataFrame, source: str, size: str) -> DataFrame:
    """``(source, source_size, place)``: sources in order of code points, null last, from 0; no task sees more than its range of them."""
    sums = cut(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")).orderBy(F.asc_nulls_last("source")))
    sums = sums.select("source", "source_size", F.monotonically_increasing_id().alias("__row"))
    sums = sums.withColumn("__part", F.shiftright("__row", 33))
    counts = sorted((r["__part"], r["count"]) for r in sums.groupBy("__part").count().collect())  # a number for each partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(sums.sparkSession.createDataFrame(starts, "__part long, __start long"))
    return sums.join(offsets, "__part").select("source", "source_size", (F.col("__start") + F.col("__row") - F.shiftleft("__part", 33)).alias("place"))


def with_targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``sources`` with ``target``."""
    if not weights or min(weights) < 1:
        raise ValueError("weights are whole numbers from 1")
    dealt = F.array(*(F.lit(int(w)) for w in weights))
    sources = sources.withColumn("__weight", F.element_at(dealt, (F.col("place") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = cap <= F.col("__weight") * level
        now = sources.agg(F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("__weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if now["n"] == capped or not now["open"]:
            level = level if now["open"] else float("inf")
            break
        capped, level = now["n"], (share * words - (now["full"] or 0)) / now["open"]
    target = cap.cast("double") if level == float("inf") else F.least(cap.cast("double"), F.col("__weight") * F.lit(level))
    return sources.withColumn("target", target).drop("__weight")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, *carry, size, source_size, target, copies, taken)`` of all documents; ``copies`` is how often the mix takes one."""
    h, source, size, row, part, bits, place, before, need, n, rank = (internal(x) for x in ("h", "source", "size", "row", "part", "bits", "place", "before", "need", "n", "rank"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = list(dict.fromkeys([id_col, *carry]))
    sized = docs.select(*kept, F.col(source_col).alias(source), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias(size), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1).alias(h))
    sized = cut(sized.withColumn(row, F.monotonically_increasing_id()))
    sources = cut(with_targets(ranked_sources(sized, source, size), weights, share, most))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 0
        group = group.sort_values("length")
        extra = fit_lengths(group["length"].tolist(), group["count"].tolist(), round(target - whole * total), seed) if whole < most else [0] * len(group)
        return group.assign(whole=whole, extra=extra)[["source", "length", "count", "source_size", "target", "whole", "extra"]]

    lengths = sized.groupBy(F.col(source).alias("source"), F.col(size).alias("length")).count()
    lengths = lengths.alias("l").join(sources.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    lengths = cut(lengths.groupBy("source").applyInPandas(fitted, "source string, length long, count long, source_size long, target double, whole int, extra long"))
    stats = lengths.agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    width = min(RANGE_BITS, max(0, (int(stats["most"] or 0) // RANGE_ROWS).bit_length()))
    span = F.shiftright(h, 63 - width).cast("int") if width else F.lit(0)

    def near(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
        """A join by source and length: a table of lengths is broadcast while it is small, else its rows are repeated for the pieces of a hot length."""
        on = lambda: [F.col(a).eqNullSafe(F.col(b)) for a, b in keys]
        if stats["n"] <= BROADCAST_LENGTHS:
            return left.join(F.broadcast(right), on(), "left")
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return left.withColumn(place, F.pmod(F.xxhash64(row), F.lit(SALTS))).join(salted, [*on(), F.col(place) == F.col("__salt")], "left").drop(place, "__salt")

    # the range of hashes in which a length's limit lies: of those before it all rows are taken, of those after it none
    choice = lengths.where((F.col("extra") > 0) & (F.col("extra") < F.col("count")))
    choice = choice.select(F.col("source").alias("__s"), F.col("length").alias("__l"), "extra")
    held = near(sized.select(source, size, span.alias(bits), row), choice, [(source, "__s"), (size, "__l")]).where("extra is not null")
    ranges = held.groupBy(source, size, "extra", bits).agg(F.count("*").alias(n))
    running = F.sum(n).over(Window.partitionBy(source, size).orderBy(bits).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    limit = ranges.withColumn(before, running - F.col(n)).where((F.col(before) < F.col("extra")) & (F.col(before) + F.col(n) >= F.col("extra")))
    limit = cut(limit.select(F.col(source).alias("__bs"), F.col(size).alias("__bl"), F.col(bits).alias("__limit"), (F.col("extra") - F.col(before)).alias(need)))
    fits = lengths.alias("f").join(limit, F.col("source").eqNullSafe(F.col("__bs")) & (F.col("length") == F.col("__bl")), "left")
    fits = fits.select(F.col("source").alias("__s"), F.col("length").alias("__l"), "count", "source_size", "target", "whole", "extra", "__limit", need)
    dealt = near(sized.withColumn(bits, span), fits, [(source, "__s"), (size, "__l")]).drop("__s", "__l")

    # rows of that range, ranked by hash; rows that repeat one are counted by partition first
    edge = F.col("__limit").isNotNull() & (F.col(bits) == F.col("__limit"))
    edges = dealt.where(edge).select(source, size, h, row, need, F.shiftright(row, 33).alias(part))
    groups = edges.groupBy(source, size, h, part).agg(F.count("*").alias(n))
    order = Window.partitionBy(source, size).orderBy(h, part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.select(F.col(source).alias("__gs"), F.col(size).alias("__gl"), F.col(h).alias("__gh"), F.col(part).alias("__gp"), (F.sum(n).over(order) - F.col(n)).alias(before))
    within = F.row_number().over(Window.partitionBy(source, size, h, part).orderBy(row))
    same = F.col(source).eqNullSafe(F.col("__gs")) & (F.col(size) == F.col("__gl")) & (F.col(h) == F.col("__gh")) & (F.col(part) == F.col("__gp"))
    edges = edges.withColumn(rank, within).join(groups, same).where(F.col(before) + F.col(rank) <= F.col(need)).select(F.col(row).alias("__picked"))

    def out(rows: DataFrame, more: Column) -> DataFrame:
        copies = F.when(F.col(size) > 0, F.col("whole") + more).otherwise(0).cast("int")
        return rows.select(*kept, F.col(size).alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col(size)).cast("long").alias("taken"))

    clear = F.when(F.col("__limit").isNotNull(), F.col(bits) < F.col("__limit")).otherwise(F.col("extra") > 0)
    picked = dealt.where(edge).join(edges, F.col(row) == F.col("__picked"), "left")
    return out(dealt.where(~edge), clear.cast("int")).unionByName(out(picked, F.col("__picked").isNotNull().cast("int")))


def op11_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
