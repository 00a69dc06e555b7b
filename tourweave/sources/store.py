"""Tables of tours: a key-value store on files, backups, lists and provider answers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.records import delivery_label

BACKUP_VERSION = 5
TEXT_FORMATS, UNREAD_FORMATS = ("txt", "csv", "text"), ("pdf", "png", "jpg", "jpeg", "webp")


# --- store ---------------------------------------------------------------------------------------
def last_of_each(rows: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Of rows that repeat a key the last by ``order``, or by where they stand in ``rows``."""
    last = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    placed = rows.withColumn("__at", F.monotonically_increasing_id() if order is None else order)
    return placed.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the last write wins among those of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(last_of_each(new.select(*old.columns), *keys, order=order))


def delete(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def meta_values(meta: DataFrame, **keys: str) -> DataFrame:
    """One row: the value of each key under the given name, null if it is missing."""
    found = meta.where(F.col("key").isin(list(keys.values())))
    return found.agg(*(F.max(F.when(F.col("key") == key, F.col("value"))).alias(name) for name, key in keys.items()))


class Store:
    """Named tables in a folder.

    A write goes to a new version.  Then a pointer of the next number is published by one rename to
    a name that is not taken; the highest complete pointer counts.  So a reader, and a writer after a crash
    at any step, finds all of a write or the table before it.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """``(number, file)`` of the published pointers, the newest first."""
        fs, path = self._fs()
        folder = path(f"{self.folder}/{name}")
        files = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(((int(f[8:]), f) for f in files if f.startswith("pointer-")), reverse=True)

    def _current(self, name: str) -> str | None:
        for _, file in self._pointers(name):
            held = self.spark.read.text(f"{self.folder}/{name}/{file}").collect()  # one line
            if len(held) == 1 and len(held[0][0]) == 32:
                return held[0][0]
        return None

    def read(self, name: str) -> DataFrame | None:
        version = self._current(name)
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        number = max([0, *(n for n, _ in self._pointers(name))]) + 1
        fs, path = self._fs()
        draft = path(f"{self.folder}/{name}/{version}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        if not fs.rename(draft, path(f"{self.folder}/{name}/pointer-{number:012d}")):
            raise OSError(f"{name}: the new version could not be published")

    def put(self, name: str, rows: DataFrame, *keys: str) -> None:
        old = self.read(name)
        self.write(name, last_of_each(rows, *keys) if old is None else upsert(old, rows, *keys))

    def remove(self, name: str, gone: DataFrame, *keys: str) -> None:
        if (old := self.read(name)) is not None:
            self.write(name, delete(old, gone, *keys))

    def get(self, name: str, condition: Column) -> DataFrame | None:
        table = self.read(name)
        return None if table is None else table.where(condition)


def current_tour(tours: DataFrame, meta: DataFrame) -> DataFrame:
    """The tour that the pointer ``currentTourId`` names."""
    pointer = meta.where(F.col("key") == "currentTourId").select(F.col("value").alias("tour_id"))
    return tours.join(F.broadcast(pointer.limit(1)), tours["tour_id"].cast("string") == pointer["tour_id"], "left_semi")


def migrate(existing: DataFrame, generations: list[DataFrame]) -> DataFrame:
    """Stops of the newest older generation that has any, unless there are tours already.
    ``generations``: newest first, each with stops or bare addresses."""
    tagged = None
    for i, g in enumerate(generations):
        text = lambda c: F.col(c) if c in g.columns else F.lit("")  # noqa: E731, B023
        rows = g.select(F.lit(i).alias("__gen"), "pos", text("name").alias("name"), text("address").alias("address"), text("postal").alias("postal"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    if not existing.isEmpty():
        tagged = tagged.where("false")
    newest = tagged.agg(F.min("__gen").alias("__gen"))  # one row
    return tagged.join(F.broadcast(newest), "__gen").select("pos", "name", "address", "postal")


# --- lists and backups -----------------------------------------------------------------------------
def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Text lists, a file a row: ``(path, text)``.  Scans and PDF files have readers of their own
    outside of this library, whose words come in as tables."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "txt"
    if kind in UNREAD_FORMATS:
        raise ValueError(f"{kind}: pass the recognised words as a table")
    if kind not in TEXT_FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


#: The columns of an exported list.
CSV_HEADER = ("Nr", "Kunde", "Adresse", "PLZ Ort", "Lieferart", "Status", "Notiz")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(stops: DataFrame) -> DataFrame:
    """``(tour_id, line_no, line)``: the header as line 0, then a line a stop, every value quoted."""
    values = [F.col("pos") + 1, F.col("name"), F.col("address"), F.col("postal"), delivery_label(F.col("delivery_type")), F.col("status"), F.col("note")]
    rows = stops.select("tour_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.concat_ws(";", *map(_quoted, values)).alias("line"))
    head = stops.select("tour_id").distinct().select("tour_id", F.lit(0).cast("long").alias("line_no"), F.lit(";".join(f'"{h}"' for h in CSV_HEADER)).alias("line"))
    return head.unionByName(rows)


def csv_files(stops: DataFrame) -> DataFrame:
    """``(tour_id, content)`` with the byte order mark and newlines."""
    grouped = csv_lines(stops).groupBy("tour_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return grouped.select("tour_id", F.concat(F.lit("﻿"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content"))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "(?iu)[^a-z0-9äöüß_-]+", "_")


def backup(tours: DataFrame, stops: DataFrame) -> DataFrame:
    """One JSON document per tour, as a backup file lists them: ``(tour_id, document)``."""
    fields = F.struct("pos", F.struct("stop_id", "name", "address", "postal", "status", "note").alias("s"))
    held = stops.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(fields)), lambda x: x["s"]).alias("stops"))
    return tours.join(held, "tour_id", "left").select("tour_id", F.to_json(F.struct(F.lit(BACKUP_VERSION).alias("version"), "tour_id", "name", F.coalesce("stops", F.array()).alias("stops"))).alias("document"))


DOCUMENT = "version int, tour_id string, name string, stops array<struct<stop_id:string,name:string,address:string,postal:string,status:string,note:string>>"


def restore(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """``(tour_id, old_id, name, stops)`` of backup documents; an id that is taken is replaced, what exists stays.
    Documents without stops are not backups and drop out."""
    read = documents.select(F.from_json("document", DOCUMENT).alias("d")).where("d.stops IS NOT NULL").select("d.*")
    taken = existing.select(F.col("tour_id").cast("string").alias("tour_id"), F.lit(True).alias("taken")).distinct()
    return read.join(taken, "tour_id", "left").select(F.when(F.col("taken"), F.uuid()).otherwise(F.col("tour_id")).alias("tour_id"), F.col("tour_id").alias("old_id"), "name", "stops")


def write_text(df: DataFrame, path: str) -> None:
    """A column of lines as text files."""
    df.write.mode("error").text(path)


# --- providers --------------------------------------------------------------------------------------
def paced(requests: DataFrame, call: Callable[[str], str], interval: float = 1.1, id_col: str = "request_id", body_col: str = "body") -> DataFrame:
    """``(request_id, response, error)`` from a service that takes one call per ``interval`` seconds.

    One partition keeps the pace, whatever the cluster; errors become rows.  ``call`` is the
    client and must have a time limit of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for b in batches:
            out = []
            for key, body in zip(b["id"], b["body"]):
                time.sleep(max(0.0, last + interval - time.monotonic()))
                last = time.monotonic()
                try:
                    out.append((key, call(body), None))
                except Exception as e:  # a failed request is a result
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["request_id", "response", "error"])

    return requests.select(F.col(id_col).cast("string").alias("id"), F.col(body_col).alias("body")).coalesce(1).mapInPandas(run, "request_id string, response string, error string")


def geocoder_requests(stops: DataFrame, service: str, country: str | None = None, limit: int = 5) -> DataFrame:
    """``(request_id, body)``: the address of each query; only address and postal line leave the house."""
    query = X.url_component(X.join_parts(", ", F.col("address"), F.col("postal")))
    tail = f"&lang=de&limit={limit}" + (f"&countrycode={country}" if country else "")
    return stops.select(F.col("stop_id").alias("request_id"), F.concat(F.lit(f"{service}?q="), query, F.lit(tail)).alias("body"))


def router_requests(points: DataFrame, service: str) -> DataFrame:
    """``(plan_id, trip, route)``: the two questions of a plan of 2 to 81 valid points, coordinates to six places."""
    from ..functions.geo import valid_point

    at = F.struct("pos", F.concat(F.format_string("%.6f", "lon"), F.lit(","), F.format_string("%.6f", "lat")).alias("c"))
    tours = points.groupBy(F.col("tour_id").alias("plan_id")).agg(F.sort_array(F.collect_list(at)).alias("p"), F.bool_and(valid_point(F.col("lat"), F.col("lon"))).alias("fine"))
    path = F.array_join(F.transform("p", lambda x: x["c"]), ";")
    shape = "overview=full&geometries=geojson&steps=false"
    trip = F.concat(F.lit(f"{service}/trip/v1/driving/"), path, F.lit(f"?source=first&destination=any&roundtrip=false&{shape}"))
    return tours.where(F.col("fine") & F.size("p").between(2, 81)).select("plan_id", trip.alias("trip"), F.concat(F.lit(f"{service}/route/v1/driving/"), path, F.lit(f"?{shape}")).alias("route"))


CANDIDATES = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,street:string,housenumber:string,postcode:string,city:string,town:string,village:string,district:string,country:string,countrycode:string,type:string>>>"


def candidates_from_json(responses: DataFrame) -> DataFrame:
    """Geocoder answers ``(request_id, response)`` as candidate rows in their order."""
    from ..operators.match import label

    rows = responses.select("request_id", F.posexplode(F.from_json("response", CANDIDATES)["features"]).alias("cand_pos", "f"))
    p, at, text = F.col("f.properties"), F.col("f.geometry.coordinates"), lambda c: F.coalesce(c, F.lit(""))
    place = F.coalesce(*(X.blank_to_null(p[k]) for k in ("city", "town", "village", "district")))
    return rows.select(
        "request_id", "cand_pos", F.try_element_at(at, F.lit(2)).alias("lat"), F.try_element_at(at, F.lit(1)).alias("lon"), text(p["street"]).alias("street"), text(p["housenumber"]).alias("house"),
        text(p["postcode"]).alias("postal"), text(p["countrycode"]).alias("country"), text(p["type"]).alias("kind"), text(p["name"]).alias("name"), label(p["name"], p["street"], p["housenumber"], p["postcode"], place, p["country"]).alias("label"),
    )


def start_points(fixes: DataFrame, metres: float = 1000) -> DataFrame:
    """The first position fix of each tour that is accurate enough."""
    return fixes.where(F.col("accuracy") <= metres).groupBy("tour_id").agg(F.min_by(F.struct("lat", "lon"), "ts").alias("p")).select("tour_id", "p.lat", "p.lon")
