"""Product codes of vectors, with the nearest entries found by annular norm pruning.

Vectors of whole numbers (see ``vectors``) are cut into equal consecutive parts, and each part is replaced by the
index of the nearest entry of its position's codebook.  The entries of a codebook are sorted by norm.  As
``| |p| - |c| | <= |p - c|``, an entry can be nearest only if its norm lies within the best distance so far
of the part's own norm: two binary searches give that interval, entries are evaluated outwards from the
part's norm, inclusively and exactly, and each better one makes the interval narrower.

The codebooks (parts x entries x width whole numbers, whatever the data) are all that the driver holds.
They start as the vectors with the smallest ids; in each round every task assigns its rows and
sends on one sum for each entry and component, so a hot vector or label costs no more than any other.

Edge cases: vectors as in ``vectors``; a length that is no multiple of ``parts`` is filled up with zeros;
null ids sort last, rows that repeat an id sort by their vector, and each row takes a place of its own among the first
entries; with fewer rows than ``entries`` the codebooks are shorter; an empty table gives an empty
result; a label's sum that passes 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, internal, table
from .vectors import scaled, unpacked

#: Partial sums come from this many tasks at most.
MOST_PARTIALS = 1024
#: More labels than this are joined, in ``SALTS`` pieces each, not broadcast.
BROADCAST_LABELS = 100_000
SALTS = 16


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = np.asarray(entries, np.int64)
        norms = np.sqrt((self.entries**2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], self.entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part the index of the nearest entry (ties: the lowest) and the squared distance; and how many entries were evaluated."""
        k, none = len(self.order), np.iinfo(np.int64).max
        own = np.sqrt((parts**2).sum(axis=1))
        left = np.searchsorted(self.norms, own)
        right = left.copy()  # entries from left to right have been evaluated
        best = np.full(len(parts), none)  # distance * k + index, so that the lower index wins a tie
        columns = [(np.ascontiguousarray(p), np.ascontiguousarray(e)) for p, e in zip(parts.T, self.sorted.T)]

        def evaluate(who: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
            some = ends > starts
            who, starts, sizes = who[some], starts[some], (ends - starts)[some]
            if not len(who):
                return 0
            first = np.cumsum(sizes) - sizes
            entry, part = np.arange(sizes.sum()) - np.repeat(first - starts, sizes), np.repeat(who, sizes)
            distance = np.zeros(len(entry), np.int64)
            for of_parts, of_entries in columns:
                distance += (of_parts[part] - of_entries[entry]) ** 2
            best[who] = np.minimum(best[who], np.minimum.reduceat(distance * k + self.order[entry], first))
            return len(entry)

        active, step, evaluated = np.arange(len(parts)), 2, 0
        while len(active):
            reach = np.where(best[active] == none, np.inf, np.sqrt(best[active] // k))
            slack = 1e-9 * (1 + own[active]) + np.where(np.isinf(reach), 0, 1e-9 * reach)  # norms are rounded, so the bounds give way a little
            low = np.searchsorted(self.norms, own[active] - reach - slack, "left")
            high = np.searchsorted(self.norms, own[active] + reach + slack, "right")
            more = (left[active] > low) | (right[active] < high)
            active, low, high = active[more], low[more], high[more]
            at, to = left[active], right[active]
            left[active], right[active] = np.minimum(at, np.maximum(low, at - step)), np.maximum(to, np.minimum(high, to + step))
            evaluated += evaluate(active, left[active], at) + evaluate(active, to, right[active])
            step *= 2
        return best % k, best // k, evaluated


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry indices and squared distances, a row a vector and a column a part."""
    width = books[0].shape[1]
    padded = np.pad(x, ((0, 0), (0, len(books) * width - x.shape[1])))
    found = [Codebook(b).nearest(padded[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_entries(rows: DataFrame, dim: int, id_col: str, parts: int, entries: int) -> list[np.ndarray]:
    width = max(1, -(-dim // parts))
    first = rows.orderBy(F.asc_nulls_last(id_col), "__x").limit(entries).collect()
    x = np.frombuffer(b"".join(bytes(r["__x"]) for r in first), "<i4").reshape(len(first), dim).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, parts * width - dim)))
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def refined(rows: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: all parts assigned, each used entry replaced by the floor of its parts' mean."""
    parts, (entries, width) = len(books), books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = unpacked(b.column("__x"), dim)
            chosen, _ = assign(x, books)
            padded = np.pad(x, ((0, 0), (0, parts * width - dim)))
            for p in range(parts):
                np.add.at(total[p], chosen[:, p], padded[:, p * width : (p + 1) * width])
                count[p] += np.bincount(chosen[:, p], minlength=entries)
        used = np.flatnonzero(np.repeat(count.reshape(-1), width))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used]), pa.array(np.repeat(count.reshape(-1), width)[used])], ["cell", "s", "n"])

    partial = rows.select("__x").coalesce(MOST_PARTIALS).mapInArrow(sums, "cell long, s long, n long")
    out = np.stack(books)
    for r in partial.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # parts x entries x width numbers
        out.reshape(-1)[r["cell"]] = r["s"] // r["n"]
    return list(out)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, label, code, error, label_error)`` of all rows that have a whole vector, and the codebooks (at most 256 entries each)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    rows, dim = scaled(vectors.select(F.col(id_col), F.col(label_col), F.col(vector_col)), vector_col, (id_col, label_col))
    books = first_entries(rows, dim, id_col, parts, entries)
    out_schema = rows.drop("__x").schema.add("code", "string").add("error", "long")
    if not len(books[0]):
        return vectors.sparkSession.createDataFrame([], out_schema.add("label_error", "long")), books
    for _ in range(rounds):
        books = refined(rows, dim, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen, distance = assign(unpacked(b.column("__x"), dim), books)
            codes = pa.array([r.tobytes().hex() for r in chosen.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column(label_col), codes, pa.array(distance.sum(axis=1))], [id_col, label_col, "code", "error"])

    coded = cut(rows.mapInArrow(encode, out_schema))
    same, salt = internal("label"), internal("salt")
    totals = cut(coded.groupBy(F.col(label_col).alias(same)).agg(F.try_sum("error").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(totals), coded[label_col].eqNullSafe(totals[same]))
    else:
        dealt = coded.withColumn(salt, F.pmod(F.xxhash64("code", id_col), F.lit(SALTS)))
        totals = totals.withColumn(f"{salt}r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = dealt.join(totals, dealt[label_col].eqNullSafe(totals[same]) & (F.col(salt) == F.col(f"{salt}r")))
    return joined.select(id_col, label_col, "code", "error", "label_error"), books


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(number: int) -> str:
    """Assignment to the entries of round ``number``, and the entries of the next."""
    return f"""
assigned{number} as (
  select v.vec_id, v.label, v.part, arg_min(b.entry, (v.norm - 2 * list_dot_product(v.x, b.x) + b.norm, b.entry)) as entry,
         min(v.norm - 2 * list_dot_product(v.x, b.x) + b.norm)::bigint as error
  from parts v join book{number} b using (part) group by all
), means{number} as (
  select part, entry, place, floor(sum(c) / count(*)) as c
  from (select p.part, a.entry, generate_subscripts(p.x, 1) as place, unnest(p.x) as c from assigned{number} a join parts p using (vec_id, part))
  group by all
), book{number + 1} as (
  select b.part, b.entry, coalesce(m.x, b.x) as x, list_dot_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) as norm
  from book{number} b left join (select part, entry, list(c order by place) as x from means{number} group by all) m using (part, entry)
)"""


#: For tables whose vec_ids are unique and whose vectors have one length; whole numbers are exact in doubles here.
OP13_SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda c: floor(256 * c::double) + 0) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), parts as (
  select vec_id, label, part, x, list_dot_product(x, x) as norm
  from (select vec_id, label, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] as x from kept, range(16) r(part))
), book0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, x, norm
  from parts where vec_id in (select vec_id from kept order by vec_id limit 64)
), {_round_sql(0)}, {_round_sql(1)},
assigned2 as (
  select v.vec_id, v.label, v.part, arg_min(b.entry, (v.norm - 2 * list_dot_product(v.x, b.x) + b.norm, b.entry)) as entry,
         min(v.norm - 2 * list_dot_product(v.x, b.x) + b.norm)::bigint as error
  from parts v join book2 b using (part) group by all
), coded as (
  select vec_id, label, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(error)::bigint as error
  from assigned2 group by all
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, place)) from (select part, entry, generate_subscripts(x, 1) as place, unnest(x) as c from book2)) as codebooks_sha256
from coded
"""
