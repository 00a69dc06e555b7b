"""The library's tables stated over the driver's tables, once for Spark and once for DuckDB.

A customer's orders are a tour: its stops are in order of date and order key.  All numbers
come from integer arithmetic, so both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    """A query over the named tables, without leaving views behind."""
    return spark.sql(query, **{n: table(spark, sf_dir, n) for n in names})


STREETS = ("Mühlstraße", "Linden Weg", "Am Kai", "Rosengasse", "Hauptstr.", "Birkenallee", "Öder Platz")

STOPS_SQL = f"""
stops AS (
  SELECT o_custkey AS tour_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
         o_orderkey AS stop_id,
         concat('Kunde ', CAST(o_custkey AS VARCHAR)) AS name,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(
           CASE o_orderkey % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STREETS))} END, ' ', CAST(o_orderkey % 90 + 1 AS VARCHAR),
           CASE WHEN o_orderkey % 5 = 0 THEN ' A' ELSE '' END) END AS address,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(CAST(1000 + o_orderkey % 9000 AS VARCHAR), '  Ort') END AS postal,
         CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'later'
              WHEN o_orderpriority = '5-LOW' THEN 'not_delivered' ELSE 'done' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'Lieferpaket' ELSE 'Kollektion 38 B' END AS delivery_type,
         CASE WHEN o_orderkey % 4 = 0 THEN 'say "hi"; twice' ELSE '' END AS note,
         CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM orders)
"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    streets = F.element_at(F.array(*map(F.lit, STREETS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tour_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        key.alias("stop_id"),
        F.concat(F.lit("Kunde "), F.col("o_custkey").cast("string")).alias("name"),
        F.when(key % 11 == 0, "").otherwise(F.concat(streets, F.lit(" "), (key % 90 + 1).cast("string"), F.when(key % 5 == 0, " A").otherwise(""))).alias("address"),
        F.when(key % 13 != 0, F.concat((key % 9000 + 1000).cast("string"), F.lit("  Ort"))).alias("postal"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "later").when(F.col("o_orderpriority") == "5-LOW", "not_delivered").otherwise("done").alias("status"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "Lieferpaket").otherwise("Kollektion 38 B").alias("delivery_type"),
        F.when(key % 4 == 0, 'say "hi"; twice').otherwise("").alias("note"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


#: Map points per stop in whole micro-degrees, a few of them out of bounds.
POINTS_SQL = """
points AS (
  SELECT tour_id, pos, stop_id,
         CAST(CASE WHEN stop_id % 97 = 0 THEN 95000000 ELSE 48000000 + (stop_id * 7919) % 400 * 100 END AS DOUBLE) / 1000000 AS lat,
         CAST(15000000 + (stop_id * 104729) % 300 * 100 AS DOUBLE) / 1000000 AS lon
  FROM stops)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("stop_id")
    lat = F.when(key % 97 == 0, 95_000_000).otherwise(48_000_000 + (key * 7919) % 400 * 100).cast("double") / 1_000_000
    lon = (15_000_000 + (key * 104729) % 300 * 100).cast("double") / 1_000_000
    return stops(spark, sf_dir).select("tour_id", "pos", "stop_id", lat.alias("lat"), lon.alias("lon"))
