"""Vectors as whole numbers, for the operators that need exact sums and distances.

A component ``c`` becomes ``floor(256 c)``, kept within ``+-2 ** 24`` so that squares and sums stay exact in 64 bits;
vectors are packed as little-endian 32-bit integers.  Vectors that are null or hold null, NaN or infinite
components are left out, and so are vectors of another length than most of the others have (the
smaller length, if two are as frequent).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 24


def finite_rows(vectors: DataFrame, vector_col: str, carry: Sequence[str]) -> tuple[DataFrame, int]:
    """``(*carry, v)`` of the rows whose vector is whole and of the commonest length, and that length (0: no rows)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(*carry, F.col(vector_col).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull())
    rows = rows.where(F.forall("__v", finite))
    length = rows.groupBy(F.size("__v").alias("__n")).count().orderBy(F.desc("count"), "__n").first()
    dim = length["__n"] if length else 0
    return rows.where(F.size("__v") == dim), dim


def scaled(vectors: DataFrame, vector_col: str, carry: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``(*carry, __x)`` with packed whole numbers, and the vectors' length."""
    rows, dim = finite_rows(vectors, vector_col, carry)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("__v").flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(flat * 256.0), -LARGEST, LARGEST).astype("<i4").reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array([r.tobytes() for r in x], pa.binary())], [*carry, "__x"])

    schema = rows.drop("__v").schema.add("__x", "binary")
    return rows.mapInArrow(pack, schema), dim


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers of a batch, one row a vector."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)
