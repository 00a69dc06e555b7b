"""Backups of all tours as one JSON file, written and read without one task holding it.

A file has ``version``, ``exportedAt``, ``tours`` and ``meta``.  It is written as ordered lines, a tour a line, and put
together by copying bytes.  To read one, whatever its layout, the text is cut at every ``}``, which never parts an escape.
Whether a piece starts within a string follows from the quotes before it, how deep it lies from the brackets before it; both are running
sums, over the pieces of a block and over the blocks.  A piece that ends at depth 2 of the array ``tours`` ends a tour; so each tour's
pieces come together by its number, and only they.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.routes import valid_snapshot
from ..stages import cut

VERSION = 5
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Names of a stop's and a tour's fields in the file, and here.
STOP_FIELDS = {"id": "stop_id", "name": "name", "address": "address", "postal": "postal", "deliveryType": "delivery_type", "deliveryReview": "delivery_review", "deliverySource": "delivery_source", "note": "note", "status": "status", "completedAt": "completed_at", "needsReview": "needs_review"}
TOUR_FIELDS = {"id": "tour_id", "name": "name", "source": "source", "createdAt": "created_at", "updatedAt": "updated_at", "currentIndex": "current_index"}
#: Kept only if they are texts in the file.
ONLY_TEXT = ("deliveryType", "deliveryReview", "deliverySource")
ROUTE_MAP = "version int, order array<int>, points array<struct<lat:double,lon:double,id:string>>, before struct<duration:double,distance:double>, after struct<duration:double,distance:double>"


def _iso(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), ISO)


# --- writing ----------------------------------------------------------------------------------------
def backup_lines(tours: DataFrame, stops: DataFrame, meta: DataFrame, exported_at: Column) -> DataFrame:
    """``(place, line)``: the file line by line; tours by id.

    ``tours(tour_id, name, source, created_at, updated_at, current_index[, route_undo, route_map])`` with the last two as JSON texts,
    ``stops`` as from ``records.normalize_stops``, ``meta(key, value)``.  Only ``currentTourId`` of meta is part of a backup.
    """
    time = ("created_at", "updated_at", "completed_at")
    fields = lambda names: [(_iso(F.col(b)) if b in time else F.col(b).cast("string") if b in ("tour_id", "stop_id") else F.col(b)).alias(a) for a, b in names.items()]
    one = F.struct("pos", F.struct(*fields(STOP_FIELDS)).alias("s"))
    held = stops.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("stops"))
    raw = lambda c: F.parse_json(c) if c in tours.columns else F.lit(None).cast("string")
    whole = F.struct(*fields(TOUR_FIELDS), F.coalesce("stops", F.array().cast(held.schema["stops"].dataType)).alias("stops"), raw("route_undo").alias("routeUndo"), raw("route_map").alias("routeMap"))
    key = F.col("tour_id").cast("string")
    bodies = tours.join(held, "tour_id", "left").select(F.lit(1).alias("part"), key.alias("key"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("line"))
    # every tour but the first one follows a comma
    first = tours.agg(F.min(key).alias("first"))
    bodies = bodies.join(F.broadcast(first)).select("part", "key", F.when(F.col("key") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    current = meta.where(F.col("key") == "currentTourId").agg(F.max("value").alias("currentTourId"))
    ends = current.select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit(f'{{"version":{VERSION},"exportedAt":'), F.lit('"'), _iso(exported_at), F.lit('"'), F.lit(',"tours":[')).alias("line")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit('],"meta":'), F.to_json(F.struct("currentTourId"), {"ignoreNullFields": "false"}), F.lit("}")).alias("line")),
    )).alias("e")).select("e.part", F.lit("").alias("key"), "e.line")
    return bodies.unionByName(ends).select(F.struct("part", "key").alias("place"), "line")


def write_backup(lines: DataFrame, path: str) -> None:
    """One file at ``path``: sorted parts beside it, whose bytes are copied in order, a buffer at a time."""
    spark = lines.sparkSession
    lines.orderBy("place").select("line").write.mode("overwrite").text(f"{path}.parts")
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(f"{path}.parts"), hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        for part in sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
            stream = fs.open(hadoop.fs.Path(source, part))
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(source, True)


# --- reading ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Backup:
    """What files held: tours and stops with all their fields, meta values, and ``(path, error)`` of what could not be read."""

    tours: DataFrame
    stops: DataFrame
    meta: DataFrame
    errors: DataFrame


def _measured(chunks: DataFrame) -> DataFrame:
    """Pieces with their quotes, and for a start outside (0) and within (1) a string: how much deeper they end, and how far up they come."""

    def walk(text: str, within: bool, closed: bool) -> tuple[int, int, int | None]:
        depth = least = 0
        at = None  # the depth before the key of the tours
        plain = within
        parts = text.split('"')
        for i, part in enumerate(parts):
            if not plain:
                for c in part:
                    if c in "{[":
                        depth += 1
                    elif c in "}]":
                        depth -= 1
                        least = min(least, depth)
                if i >= 2 and parts[i - 1] == "tours" and part.lstrip()[:1] == ":" and part.lstrip()[1:].lstrip()[:1] == "[":
                    at = depth - part.count("[") - part.count("{") + part.count("]") + part.count("}")
            plain = not plain
        if closed and plain:  # the piece's own end, outside of strings
            depth -= 1
            least = min(least, depth)
        return depth, least, at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, block, row, text, closed in zip(b["path"], b["block"], b["row"], b["text"], b["closed"]):
                plain = _ESCAPE.sub("", text)
                outside, inside = walk(plain, False, closed), walk(plain, True, closed)
                out.append((path, block, row, text, closed, plain.count('"'), *outside, *inside))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _MEASURED.split(", ")])

    return chunks.mapInPandas(run, _MEASURED)


_MEASURED = "path string, block long, row long, text string, closed boolean, quotes long, d0 long, m0 long, t0 long, d1 long, m1 long, t1 long"


_ESCAPE = re.compile(r"\\.", re.S)


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all that stands before them in their file: within blocks, and over blocks."""
    rows = rows.withColumn("__v", value)
    blocks = rows.groupBy("path", "block").agg(F.sum("__v").alias("__b"))
    over = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("__b").over(over), F.lit(0)).alias("__base"))
    own = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(blocks), ["path", "block"]).withColumn(name, F.col("__base") + F.coalesce(F.sum("__v").over(own), F.lit(0))).drop("__v", "__base")


def split_tours(spark: SparkSession, path: str) -> DataFrame:
    """``(path, number, json, is_tour, has_tours, sound)``: each tour of the files as a text, by its number, and the text after the last one.  A file is ``sound`` if all its brackets and quotes are closed.

    Only a tour's own pieces come together in one task; the windows see one block of a file each.
    """
    files = spark.read.text(path, lineSep="}")
    pieces = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "^﻿", "").alias("text"))
    pieces = pieces.withColumn("closed", F.lit(True))
    m = cut(_measured(pieces))
    m = _before(m, F.col("quotes"), "seen").withColumn("inside", F.col("seen") % 2 == 1)
    pick = lambda x: F.when(F.col("inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    m = m.withColumns({"d": pick("d"), "least": pick("m"), "key": pick("t")})
    m = cut(_before(m, F.col("d"), "depth").select("path", "block", "row", "text", "depth", (F.col("depth") + F.col("d")).alias("after"), (F.col("depth") + F.col("least")).alias("least"), (F.col("key") + F.col("depth") == 1).alias("opens"), "inside", "quotes"))
    m = _before(m, F.coalesce(F.col("opens"), F.lit(False)).cast("long"), "opened").withColumn("opened", F.col("opened") + F.coalesce(F.col("opens"), F.lit(False)).cast("long"))
    left = (F.col("opened") > 0) & ~F.coalesce("opens", F.lit(False)) & (F.col("least") <= 1)
    m = _before(m, left.cast("long"), "ended").withColumn("ended", F.col("ended") + left.cast("long"))
    # a piece that ends outside of strings at depth 2 of the open array ends a tour
    ends = (F.col("opened") > 0) & (F.col("ended") == 0) & (F.col("after") == 2) & ((F.col("inside").cast("int") + F.col("quotes")) % 2 == 0)
    m = _before(m, ends.cast("long"), "number").withColumn("ends", ends)
    one = F.sort_array(F.collect_list(F.struct("block", "row", "text")))
    whole = m.groupBy("path", "number").agg(one.alias("p"), F.bool_or("ends").alias("is_tour"), F.max("opened").alias("opened"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "}")
    text = F.when(F.col("is_tour"), F.concat(text, F.lit("}"))).otherwise(text)
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r'^(?s).*?"tours"\s*:\s*\[\s*', "")).otherwise(F.regexp_replace(text, r"^\s*,\s*", ""))
    # by the file's size: whether it ends at a brace, or what follows the last one is a piece that has none
    sizes = files.groupBy(F.col("_metadata.file_path").alias("path")).agg((F.sum(F.octet_length("value")) + F.count("*") > F.max("_metadata.file_size")).alias("more"))
    ends_at = m.groupBy("path").agg(F.sum(F.col("after") - F.col("depth")).alias("d"), F.sum("quotes").alias("q"), F.max_by(F.struct("text", (F.col("after") - F.col("depth")).alias("d")), F.struct("block", "row")).alias("last"))
    sound = (F.col("d") - F.when(F.col("more"), F.col("last.d")).otherwise(0) == 0) & (F.col("q") % 2 == 0) & (~F.col("more") | (F.trim(F.regexp_replace("last.text", r"\s", "")) == ""))
    text = F.when(F.col("is_tour") | F.col("more"), text).otherwise(F.concat(text, F.lit("}")))
    return whole.join(ends_at.join(sizes, "path").select("path", "more", sound.alias("sound")), "path").select("path", "number", text.alias("json"), "is_tour", ((F.col("opened") > 0) & F.col("sound")).alias("has_tours"), "sound")


def read_backup(spark: SparkSession, path: str, existing: DataFrame, now: Column, run_id: str) -> Backup:
    """The backups at ``path``, with the defaults that reading gives, next to the tours of ``existing(tour_id)``.

    An id that exists, or that an earlier tour of the same read has, is replaced; missing and replaced ids are hashes of
    ``run_id`` and the tour's place, so a task that runs again gives the same ones.  Files that end too early or have no ``tours`` array, and tours that can't
    be read, are reported in ``errors``; nothing of the former is read.
    """
    parts = cut(split_tours(spark, path))
    stop = "struct<" + ",".join(f"{a}:{'variant' if a in ONLY_TEXT or a == 'needsReview' else 'string'}" for a in STOP_FIELDS) + ">"
    schema = "id string, name string, source string, createdAt string, updatedAt string, currentIndex variant, stops array<" + stop + ">, routeUndo variant, routeMap variant, __broken string"
    read = parts.where("is_tour AND has_tours").select("path", "number", F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("t"))
    files = parts.groupBy("path").agg(F.bool_or("has_tours").alias("ok"), F.bool_and("sound").alias("sound"))
    errors = files.where("NOT ok").select("path", F.when(F.col("sound"), "no tours array").otherwise("not a whole document").alias("error"))
    errors = errors.unionByName(read.where("t.__broken IS NOT NULL").select("path", F.concat(F.lit("tour "), F.col("number").cast("string"), F.lit(" can't be read")).alias("error")))
    hashed = lambda *c: F.substring(F.sha2(F.concat_ws("/", F.lit(run_id), *(x.cast("string") for x in c)), 256), 1, 32)
    good = read.where("t.__broken IS NULL").select("path", "number", "t.*").drop("__broken")
    own = F.coalesce(X.blank_to_null(F.col("id")), hashed(F.col("path"), F.col("number")))
    good = good.withColumn("old_id", own).withColumn("__n", F.row_number().over(Window.partitionBy("old_id").orderBy("path", "number")))
    taken = existing.select(F.col("tour_id").cast("string").alias("old_id")).distinct().withColumn("__taken", F.lit(True))
    good = good.join(taken, "old_id", "left").withColumn("tour_id", F.when(F.col("__taken") | (F.col("__n") > 1), hashed(F.col("old_id"), F.col("path"), F.col("number"))).otherwise(F.col("old_id")))
    moment = lambda c: F.try_to_timestamp(c)
    kind = lambda c: F.schema_of_variant(F.col(c) if isinstance(c, str) else c)
    snap = F.from_json(F.to_json("routeMap"), ROUTE_MAP)
    named = good.withColumn("__map", snap)
    sound = F.coalesce(valid_snapshot(F.col("__map.version"), F.col("__map.order"), F.col("__map.points"), F.col("__map.before"), F.col("__map.after")), F.lit(False))
    tours = named.select(
        "tour_id", "old_id", F.coalesce(X.blank_to_null(F.col("name")), F.lit("Unbenannte Tour")).alias("name"), F.coalesce(X.blank_to_null(F.col("source")), F.lit("manual")).alias("source"),
        F.coalesce(moment(F.col("createdAt")), now).alias("created_at"), F.coalesce(moment(F.col("updatedAt")), now).alias("updated_at"), F.coalesce(F.when(kind("currentIndex").isin("BIGINT"), F.try_variant_get("currentIndex", "$", "int")), F.lit(0)).alias("current_index"),
        F.when(~F.coalesce(F.is_variant_null("routeUndo"), F.lit(True)), F.to_json("routeUndo")).alias("route_undo"), F.when(sound, F.to_json("routeMap")).alias("route_map"),
    )
    s = good.select("tour_id", "path", "number", F.posexplode("stops").alias("pos", "s")).select("tour_id", "path", "number", F.col("pos").cast("long").alias("pos"), "s.*")
    only = lambda c: F.when(kind(c) == "STRING", F.try_variant_get(c, "$", "string"))
    true = F.when(kind("needsReview") == "BOOLEAN", F.try_variant_get("needsReview", "$", "boolean"))
    value = lambda a: F.coalesce(only(F.col(a)) if a in ONLY_TEXT else F.col(a), F.lit(""))
    stops = s.select(
        "tour_id", "pos", F.coalesce(X.blank_to_null(F.col("id")), hashed(F.col("path"), F.col("number"), F.col("pos"))).alias("stop_id"),
        *(value(a).alias(b) for a, b in STOP_FIELDS.items() if b in ("name", "address", "postal", "delivery_type", "delivery_review", "delivery_source", "note")),
        F.coalesce(X.blank_to_null(F.col("status")), F.lit("pending")).alias("status"), moment(X.blank_to_null(F.col("completedAt"))).alias("completed_at"), F.coalesce(true, F.lit(False)).alias("needs_review"),
    )
    tail = parts.where("NOT is_tour AND has_tours").select(F.get_json_object(F.regexp_replace("json", r"^\s*\]\s*,?", "{"), "$.meta").alias("m"))
    meta = tail.select(F.explode(F.from_json("m", "map<string,string>")).alias("key", "value"))
    return Backup(tours, stops, meta, errors)
