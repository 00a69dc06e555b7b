"""Progress of tours: counts by status, the next open stop, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("pending", "later")


def is_open(status: Column) -> Column:
    return status.isin(*OPEN)


def eligible(stops: DataFrame, include_later: bool = False) -> DataFrame:
    """The stops that a plan may reorder."""
    return stops.where(F.col("status").isin(*(OPEN if include_later else OPEN[:1])))


def tour_stats(stops: DataFrame) -> DataFrame:
    """Per tour: total, done, not delivered, open (unknown status counts as open), completed,
    percent, and the buttons' own count of stops that are pending or later.  One shuffle with
    map-side combine."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "not_delivered")
    counted = stops.groupBy("tour_id").agg(F.count("*").alias("total"), done.alias("done"), failed.alias("not_delivered"), F.count_if(is_open(F.col("status"))).alias("selectable"))
    left = F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("not_delivered"))
    return counted.withColumn("open", left).withColumn("completed", (F.col("total") > 0) & (F.col("open") == 0)).withColumn(
        "percent", F.when(F.col("total") > 0, (F.col("done") + F.col("not_delivered")) / F.col("total") * 100).otherwise(0.0)
    )


def next_open(stops: DataFrame, start: Column | int = 0) -> DataFrame:
    """Per tour the position of the first open stop from ``start`` on, else of the first before it, else -1."""
    start = F.lit(start) if isinstance(start, int) else start
    key = F.when(is_open(F.col("status")), F.struct((F.col("pos") < F.greatest(start, F.lit(0))).alias("before"), F.col("pos").alias("pos")))
    return stops.groupBy("tour_id").agg(F.coalesce(F.min(key)["pos"], F.lit(-1)).cast("long").alias("next_pos"))


def saved_tours(stops: DataFrame) -> DataFrame:
    """Tours with the latest change first (``rank`` from 1), and their counts."""
    latest = stops.groupBy("tour_id").agg(F.max("updated_at").alias("updated_at"))
    return tour_stats(stops).join(latest, "tour_id").orderBy(F.desc("updated_at"), "tour_id")


def missing_address(stops: DataFrame) -> DataFrame:
    """Per tour the first open stop without address or postal line; such tours are not planned."""
    blank = F.trim(F.coalesce("address", F.lit(""))).eqNullSafe("") | F.trim(F.coalesce("postal", F.lit(""))).eqNullSafe("")
    return eligible(stops, True).where(blank).groupBy("tour_id").agg(F.min(F.struct("pos", "stop_id")).alias("first")).select("tour_id", F.col("first.pos").alias("pos"), F.col("first.stop_id").alias("stop_id"))
