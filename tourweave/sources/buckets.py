"""A keyed table in buckets: only touched buckets are rewritten, and writers that meet are told.

Rows are dealt by a hash of their key to a fixed number of buckets, each a folder of parquet files.  A manifest names the
folder of every bucket.  A change writes new folders for the buckets it touches and a manifest of the next number, which
is published by a rename that fails if the name is taken.  So a change counts whole or not at all, readers keep the
version they began with, and of two writers that read the same version the second gets a ``Conflict``, whatever they touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import delete, last_of_each, upsert

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published since the version that a change was made from."""


class BucketTable:
    """The table ``name`` in ``folder`` with unique, non-null ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType | str, *keys: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, f"{folder.rstrip('/')}/{name}", keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---
    def version(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        folder = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([0, *(int(n[9:]) for n in names if n.startswith("manifest-"))])

    def _manifest(self, number: int) -> dict[int, str]:
        if not number:
            return {}
        (line,) = self.spark.read.text(f"{self.path}/manifest-{number:012d}").collect()  # one line, a folder a bucket
        return {int(b): folder for b, folder in json.loads(line[0]).items()}

    def _publish(self, folders: dict[int, str], base: int) -> int:
        draft = self._path(f"{self.path}/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        target = self._path(f"{self.path}/manifest-{base + 1:012d}")
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as error:  # the JVM's exception says why
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {base} is no longer the newest") from None
            raise
        return base + 1

    # --- reading ---
    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}" for folder in folders.values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(self.version() if version is None else version))

    def get(self, *values) -> DataFrame:
        """The row of one key; only its bucket is read."""
        key = self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in zip(self.keys, values)))
        (bucket,) = key.select(self._bucket()).first()
        rows = self._rows({b: f for b, f in self._manifest(self.version()).items() if b == bucket})
        for k, v in zip(self.keys, values):
            rows = rows.where(F.col(k) == F.lit(v))
        return rows

    # --- changes ---
    def _change(self, touched_by: DataFrame, merge: Callable[[DataFrame], DataFrame], base: int | None) -> int:
        base = self.version() if base is None else base
        folders = self._manifest(base)
        touched = {r[0] for r in touched_by.select(self._bucket().alias("b")).distinct().collect()}  # at most the number of buckets
        if not touched:
            return base
        fresh = f"data-{uuid.uuid4().hex}"
        merged = merge(self._rows({b: f for b, f in folders.items() if b in touched})).withColumn("__bucket", self._bucket())
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{fresh}")
        made = self._path(f"{self.path}/{fresh}")
        written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(made) if "=" in s.getPath().getName()}
        kept = {b: f for b, f in folders.items() if b not in touched}
        return self._publish(kept | {b: f"{fresh}/__bucket={b}" for b in written}, base)

    def upsert(self, rows: DataFrame, base: int | None = None, order=None) -> int:
        """Rows replace those with their key, the last by ``order`` of those that repeat one; the new version's number.

        ``base`` is the version that ``rows`` were made from: if it is no longer the newest, ``Conflict`` is raised and
        nothing changes.  Without it, only a writer that publishes while this one writes is a conflict.
        """
        rows = last_of_each(rows, *self.keys, order=order).select(*self.schema.names)
        return self._change(rows, lambda old: upsert(old, rows, *self.keys), base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        return self._change(keys, lambda old: delete(old, keys, *self.keys), base)

    def retry(self, change: Callable[[int], int], attempts: int = 5) -> int:
        """Make ``change`` from the newest version, again from a newer one where another writer was first."""
        for left in reversed(range(attempts)):
            try:
                return change(self.version())
            except Conflict:
                if not left:
                    raise
        raise Conflict("no attempt was made")
