"""Near copies: documents linked by the Jaccard similarity of their word shingles.

Two texts are linked if their sets of ``WIDTH``-word shingles have a Jaccard similarity of
``LEAST`` or more (words as in ``simhash_dedup``; a text with fewer words is one shingle).
Candidates come from MinHash bands; what links them is always the exact similarity:

1. Texts that share a band's ``ROWS`` minima are in one bucket.  Texts at similarity s share
   one of ``BANDS`` buckets with probability ``1 - (1 - s^ROWS)^BANDS``, 0.9998 at 0.8.
2. The leader of a bucket is the member whose buckets are the largest, so the buckets of a
   group of copies have the same one or few leaders, those nearest to what all have in common.
   Every member is tested against its leaders, and described by them: which of the
   leader's shingles it has (a bit each) and the hashes of those it has besides.
3. Members of one leader that are not in one component by then are compared with each other
   by these descriptions, which give the exact similarity.  The leader is a vantage
   point: two texts at distances a and b (one less the similarity) from it are ``|a - b|`` apart at
   least.  Large groups are split into blocks; a task returns links between components, never pairs
   of one.

Edge cases as in ``simhash_dedup``: null text counts as empty; empty texts are copies of each
other; rows that repeat a text are one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .simhash_dedup import keep_first, simhash_components

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Members of a leader that one task compares with this many others.
BLOCK, AGAINST = 2048, 32_768
#: More keys than this are joined, not broadcast.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles that are hashed at a time.
_PART = 1 << 13


def shingle_set(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    words = (text or b"").lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else {b" ".join(words)}


def bands(shingles: set[bytes]) -> list[int]:
    """One signed 64-bit key a band."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(0)), np.uint64, len(shingles))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PART):
        mixed = hashes[at : at + _PART, None] * _FACTORS + _OFFSETS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    minima = least.reshape(BANDS, ROWS)
    return [np.int64(np.uint64(xxhash.xxh64_intdigest(row.tobytes(), i)).view(np.int64)).item() for i, row in enumerate(minima)]


def similar(both, a, b):
    """Whether sets of ``a`` and ``b`` elements with ``both`` in common are linked; numbers or arrays."""
    return both >= LEAST * (a + b - both)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [bands(shingle_set(s)) for s in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(keys, pa.list_(pa.int64()))], ["text_key", "keys"])


TESTED = "u long, v long, n long, m long, both long, has binary, more binary"


def _test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describes text ``s`` of ``u`` by text ``t`` of its leader ``v``."""
    last, place = None, {}
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for v, s, t in zip(*(b.column(c).to_pylist() for c in ("v", "s", "t"))):
            if v != last:  # a leader's rows often come together
                last, place = v, {x: i for i, x in enumerate(sorted(shingle_set(t)))}
            own = shingle_set(s)
            at = [i for i in map(place.get, own) if i is not None]
            bits = np.zeros(len(place), bool)
            bits[at] = True
            more = np.fromiter((xxhash.xxh64_intdigest(x) for x in own if x not in place), np.uint64, len(own) - len(at))
            for column, value in zip(out, (len(own), len(place), len(at), np.packbits(bits).tobytes(), more.tobytes())):
                column.append(value)
        columns = [b.column("u"), b.column("v"), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.binary()) for x in out[3:])]
        yield pa.RecordBatch.from_arrays(columns, ["u", "v", "n", "m", "both", "has", "more"])


def _links(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between components among the members of one leader; those with ``asks`` against all."""
    rows = rows.sort_values(["u", "asks"]).reset_index(drop=True)
    asking, rows = rows[rows["asks"]], rows[~rows["asks"]].reset_index(drop=True)
    if asking.empty or rows.empty:
        return []
    u, root, n = rows["u"].to_numpy(), rows["root"].to_numpy(), rows["n"].to_numpy()
    far = 1 - rows["both"].to_numpy() / (n + rows["m"].to_numpy() - rows["both"].to_numpy())
    has = np.frombuffer(b"".join(rows["has"]), np.uint8).reshape(len(rows), -1)
    more = [np.sort(np.frombuffer(x, np.uint64)) for x in rows["more"]]
    beyond = np.array([len(x) for x in more])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for own, at, size, own_has, own_more, both, m in zip(*(asking[c] for c in ("u", "root", "n", "has", "more", "both", "m"))):
        own_more = np.frombuffer(own_more, np.uint64)
        distance = 1 - both / (size + m - both)
        near = np.flatnonzero((root != at) & (np.minimum(n, size) >= LEAST * np.maximum(n, size)) & (np.abs(far - distance) <= 1 - LEAST + 1e-9))
        shared = np.bitwise_count(has[near] & np.frombuffer(own_has, np.uint8)).sum(axis=1)
        at_most = shared + np.minimum(beyond[near], len(own_more))
        fit = similar(at_most, n[near], size)
        for j, k in zip(near[fit].tolist(), shared[fit].tolist()):
            if (a := find(at)) != (b := find(int(root[j]))) and similar(k + int(np.isin(own_more, more[j]).sum()), int(n[j]), size):
                parent[max(a, b)] = min(a, b)
                out.append((own, int(u[j])))
    return out


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_links(rows), columns=["u", "v"], dtype="int64")


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``TESTED`` for ``pairs(u, v)``; ``pairs`` is cut."""
    needed = pairs.select(F.col("u").alias("text_key")).union(pairs.select("v")).distinct()
    needed = F.broadcast(needed) if pairs.count() <= BROADCAST_ROWS else needed
    # a text once each, and only those that are needed are carried on
    small = cut(texts.join(needed, "text_key", "left_semi").dropDuplicates(["text_key"]))
    both = pairs.join(small.select(F.col("text_key").alias("u"), F.col("text").alias("s")), "u").join(small.select(F.col("text_key").alias("v"), F.col("text").alias("t")), "v")
    return cut(both.select("u", "v", "s", "t").mapInArrow(_test, TESTED))


def _apart(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """``(u, v)``: links between members of one leader that are in different components so far."""
    rows = tested.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    parts = rows.groupBy("v", "root").agg(F.count("*").alias("k"))
    groups = parts.groupBy("v").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    groups = groups.select("v", F.col("main.root").alias("main"), F.ceil((F.col("members") - F.col("main.k")) / BLOCK).cast("int").alias("asked"), F.ceil(F.col("members") / AGAINST).cast("int").alias("held"))
    rows = rows.join(groups, "v")
    part = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["v", "u", "root", "n", "m", "both", "has", "more"]
    asking = rows.where("root <> main").withColumn("i", part("asked")).select(*columns, F.lit(True).alias("asks"), "i", every("held").alias("j"))
    asked = rows.withColumn("j", part("held")).select(*columns, F.lit(False).alias("asks"), every("asked").alias("i"), "j")
    return asking.unionByName(asked).groupBy("v", "i", "j").applyInPandas(_compare, "u long, v long")


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_key, component_id, root)``, a row per row of ``docs``; ``known(u, v)`` has text keys that are linked already."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    signed = cut(texts.mapInArrow(_sign, "text_key long, keys array<long>"))
    member = signed.dropDuplicates(["text_key"]).select("text_key", F.explode("keys").alias("bucket"))
    shared = cut(member.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    member = cut(member.join(shared, "bucket"))
    weight = member.groupBy("text_key").agg(F.sum("members").alias("weight"))
    member = member.select("text_key", "bucket").join(weight, "text_key")
    lead = member.groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("text_key").alias("rank"), "text_key")).alias("lead"))
    pairs = member.join(lead, "bucket").where(F.col("text_key") != F.col("lead.text_key")).select(F.col("text_key").alias("u"), F.col("lead.text_key").alias("v")).distinct()
    tested = _tested(cut(pairs), texts)
    edges = tested.where(similar(F.col("both"), F.col("n"), F.col("m"))).select("u", "v")
    edges = cut(edges if known is None else edges.unionByName(known.select("u", "v")))

    roots = cut(connected_components(edges))
    more = cut(_apart(tested, roots))
    if not more.isEmpty():
        roots = cut(connected_components(edges.unionByName(more)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    named = cut(rows.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root")))
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(firsts, "root").select("doc_id", "text_key", "component_id", "root")


def simhash_links(found: DataFrame) -> DataFrame:
    """``(u, v)`` for ``known``: the text keys of each component that ``simhash_dedup`` found, linked to the least of them."""
    least = found.groupBy("root").agg(F.min("text_key").alias("v"))
    return found.join(least, "root").where("text_key <> v").select(F.col("text_key").alias("u"), "v").distinct()


def drop_simhash_and_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``keep_first`` leaves of each component of near fingerprints and near copies together."""
    known = simhash_links(simhash_components(docs, id_col, text_col))
    return keep_first(docs, near_copy_components(docs, id_col, text_col, known), id_col, text_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``keep_first`` leaves of each component of near copies."""
    return keep_first(docs, near_copy_components(docs, id_col, text_col), id_col, text_col)
