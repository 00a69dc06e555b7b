"""Byte-level BPE encoding and decoding with a segment tree per piece.

The text is cut into pieces by a pattern; each piece is merged on its own.  A segment tree
over the piece's byte positions stores at every node the least ``(rank, position)`` of the
pairs that start below it, so the root is always the leftmost pair of least rank.  A merge
joins two live neighbours in a linked list and makes three point updates of logarithmic
cost: a piece of n bytes takes O(n log n) steps, however long it is.

The vocabulary file is read once on the driver and broadcast (its size is that of the file,
whatever the corpus).  Workers keep the encodings of recent pieces and of the stretches
between spaces in dictionaries of bounded size; a full dictionary starts afresh.

Edge cases: null text counts as empty (no ids); every other text is encoded whole; repeated
rows are encoded one by one; an empty table gives an empty result; a null ``doc_id`` is kept;
other columns of the input are ignored.  Decoding an id outside the vocabulary raises; null
ids decode to null.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Entries that each worker's dictionaries may hold.
CACHE_ENTRIES = 300_000
#: A stretch longer than this is not remembered.
CACHE_LENGTH = 64
#: Children of a node of the segment tree.
FAN = 16
_NONE = 1 << 62
_BYTES = [bytes([b]) for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always merge the leftmost adjacent pair of least rank.

    The tree has ``FAN`` children a node: leaf i holds ``rank << 32 | i`` of the pair that
    starts at byte i, each node above the least of its children.  A piece of ``FAN`` bytes or
    fewer is a root with its leaves.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if not n:
        return []
    get = ranks.get
    part = list(map(_BYTES.__getitem__, piece))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = [_NONE if (r := get(piece[i : i + 2])) is None else r << 32 | i for i in range(n)]
    leaves[n - 1] = _NONE  # the last byte starts no pair
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, deep = levels[-1], len(levels) > 1
    while (least := min(top)) != _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        k = after[j]
        part[i] = joined = part[i] + part[j]
        after[i] = k
        leaves[j] = _NONE
        if k < n:
            before[k] = i
            r = get(joined + part[k])
            leaves[i] = _NONE if r is None else r << 32 | i
        else:
            leaves[i] = _NONE
        if (h := before[i]) >= 0:
            r = get(part[h] + joined)
            leaves[h] = _NONE if r is None else r << 32 | h
        if deep:
            for at in (i, j, h) if h >= 0 else (i, j):
                for depth in range(1, len(levels)):
                    at //= FAN
                    low = min(levels[depth - 1][at * FAN : at * FAN + FAN])
                    if levels[depth][at] == low:
                        break
                    levels[depth][at] = low
    ids, i = [], 0
    while i < n:
        ids.append(ranks[part[i]])
        i = after[i]
    return ids


class _Bounded(dict):
    """A dictionary that computes what it misses and starts afresh when it is full."""

    def __init__(self, compute, entries: int) -> None:
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBPE:
    """Encoder and decoder for one vocabulary and pattern; ids travel as packed uint32."""

    #: White space that a cut at single spaces would tear apart.
    _TORN = regex.compile(r" \s|\s \Z")

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.spaced = pattern_allows_space_cut(pattern)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.by_piece = _Bounded(lambda s: _packed(merge_piece(s.encode("utf-8", "replace"), ranks)), entries)
        self.by_stretch = _Bounded(self._stretch, entries)

    def _stretch(self, s: str) -> bytes:
        # a space and Latin letters are one piece under the patterns that may be cut at spaces
        if s.isalpha() and max(s) < "\u0250":
            return self.by_piece[" " + s]
        return b"".join([self.by_piece[p] for p in self.pieces.findall(" " + s)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.spaced or self._TORN.search(text):
            return b"".join([self.by_piece[p] for p in self.pieces.findall(text)])
        first, *rest = text.split(" ")
        return b"".join([self.by_piece[p] for p in self.pieces.findall(first)]) + b"".join([self.by_stretch[s] for s in rest])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def pattern_allows_space_cut(pattern: str) -> bool:
    """Whether no match of the pattern has a space but as its first character or amid white space.

    Then the pieces of a text are those of its stretches, each with the space before it.
    Shown for the pattern family of which every branch is listed here; others go unsplit.
    """
    known = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"}
    return set(pattern.split("|")) <= known


@lru_cache(maxsize=4)
def _coder(raw: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(parse_ranks(raw), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: packed ids of every text and the bytes they decode to.

    ``vocabulary`` is a path on the driver's machine to a rank file.
    """
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # some rows at a time, so that the output stays small
                part = b.slice(at, 256)
                ids = [coder.encode(x) for x in part.column("text").to_pylist()]
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_columns(docs: DataFrame, vocabulary: str, pattern: str, carry: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns in ``carry``, then ``n_tokens`` and ``ids`` (an array of integers)."""
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.frombuffer(coder.encode(x), "<i4") for x in part.column("__text").to_pylist()]
                sizes = pa.array([len(x) for x in ids], pa.int64())
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), sizes, flat], [*carry, "n_tokens", "ids"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(*carry, text_or_empty(text_col).alias("__text")).mapInArrow(run, ", ".join([*fields, "n_tokens long", "ids array<int>"]))


def decode(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` from packed ids."""
    with open(vocabulary, "rb") as file:
        shipped = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value, r"\s+")
        for b in batches:
            decoded = [None if x is None else coder.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
