"""Queries about tables that change and backups that come back; folders lie in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import proxies as P
from ..operators import records
from ..sources import backups, buckets
from ..stages import shared_folder

S = "WITH " + P.STOPS_SQL
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


@query("conflicting_writers", S + """
SELECT stop_id, CASE WHEN stop_id % 6 = 0 THEN 'second again' WHEN stop_id % 2 = 0 THEN 'first' WHEN stop_id % 3 = 0 THEN 'second again' ELSE status END AS status, 1 AS n_conflicts
FROM stops WHERE stop_id % 7 <> 0""")
def conflicting_writers(spark, d):
    """Two writers read one version: the first changes every second stop, the second each third, twice; it is refused once and then writes over the first. Then each seventh goes."""
    rows = P.stops(spark, d).select("stop_id", "status")
    table = buckets.BucketTable(spark, _folder(spark), "stops", rows.schema, "stop_id", buckets=16)
    table.upsert(rows)
    base = table.version()
    table.upsert(rows.where("stop_id % 2 = 0").withColumn("status", F.lit("first")), base)
    third = rows.where("stop_id % 3 = 0")
    second = third.withColumn("status", F.lit("second again")).withColumn("at", F.lit(2)).unionByName(third.withColumn("status", F.lit("second")).withColumn("at", F.lit(1)))
    refused = []

    def change(version: int) -> int:
        try:
            return table.upsert(second, version if refused else base, F.col("at"))
        except buckets.Conflict:
            refused.append(version)
            raise

    table.retry(change)
    table.delete(rows.where("stop_id % 7 = 0").select("stop_id"))
    return table.read().withColumn("n_conflicts", F.lit(len(refused)))


@query("whole_backups", S + """
SELECT tour_id::VARCHAR AS old_id, tour_id % 4 <> 0 AS kept_id, pos::BIGINT AS pos, stop_id::VARCHAR AS stop_id, name, address, coalesce(postal, '') AS postal, delivery_type, CASE WHEN stop_id % 5 = 0 THEN 'check } "it"' ELSE '' END AS delivery_review,
       'list [1] {' AS delivery_source, note, status, CASE WHEN status IN ('done', 'not_delivered') THEN strftime(updated_at, '%Y-%m-%d %H:%M:%S') ELSE '' END AS completed, stop_id % 3 = 0 AS needs_review, (tour_id % 5)::INTEGER AS current_index
FROM stops""")
def whole_backups(spark, d):
    """All tours written as one file and read back next to every fourth of them, which get new ids; every field of a stop comes back."""
    done, k = F.col("status").isin("done", "not_delivered"), F.col("stop_id")
    s = P.stops(spark, d).withColumns({"delivery_review": F.when(k % 5 == 0, 'check } "it"').otherwise(""), "delivery_source": F.lit("list [1] {"), "completed_at": F.when(done, F.col("updated_at")), "needs_review": k % 3 == 0})
    stops = records.normalize_stops(s)
    tours = stops.select("tour_id").distinct().select("tour_id", F.concat(F.lit("Tour "), F.col("tour_id").cast("string")).alias("name"), (F.col("tour_id") % 5).alias("current_index"))
    whole = records.normalize_tours(tours).withColumn("tour_id", F.col("tour_id").cast("long")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    meta = spark.range(1).select(F.lit("currentTourId").alias("key"), F.lit("1").alias("value"))
    path = f"{_folder(spark)}/backup.json"
    moment = F.lit("2024-01-02").cast("timestamp")
    backups.write_backup(backups.backup_lines(whole, stops, meta, moment), path)
    back = backups.read_backup(spark, path, tours.where("tour_id % 4 = 0"), moment, "run")
    t = back.tours.select("tour_id", "old_id", "current_index")
    return back.stops.join(t, "tour_id").select(
        "old_id", (F.col("tour_id") == F.col("old_id")).alias("kept_id"), "pos", "stop_id", "name", "address", "postal", "delivery_type", "delivery_review", "delivery_source", "note", "status",
        F.coalesce(F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("completed"), "needs_review", "current_index",
    )
