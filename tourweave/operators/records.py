"""Stops and tours as rows: defaults on read, filters on import, edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

STOP_TEXTS = ("name", "address", "postal", "delivery_type", "delivery_review", "delivery_source", "note")


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_stops(stops: DataFrame) -> DataFrame:
    """The stop columns with their defaults; other columns are dropped, an id is made where it is missing."""
    texts = [F.coalesce(_column(stops, n), F.lit("")).alias(n) for n in STOP_TEXTS]
    return stops.select(
        "tour_id", "pos", F.coalesce(X.blank_to_null(_column(stops, "stop_id").cast("string")), F.uuid()).alias("stop_id"), *texts,
        F.coalesce(X.blank_to_null(_column(stops, "status")), F.lit("pending")).alias("status"),
        _column(stops, "completed_at", "timestamp").alias("completed_at"),
        F.coalesce(_column(stops, "needs_review", "boolean"), F.lit(False)).alias("needs_review"),
    )


def normalize_tours(tours: DataFrame) -> DataFrame:
    """The tour columns with their defaults."""
    now = F.current_timestamp()
    return tours.select(
        F.coalesce(X.blank_to_null(_column(tours, "tour_id").cast("string")), F.uuid()).alias("tour_id"),
        F.coalesce(X.blank_to_null(_column(tours, "name")), F.lit("Unbenannte Tour")).alias("name"),
        F.coalesce(X.blank_to_null(_column(tours, "source")), F.lit("manual")).alias("source"),
        F.coalesce(_column(tours, "created_at", "timestamp"), now).alias("created_at"),
        F.coalesce(_column(tours, "updated_at", "timestamp"), now).alias("updated_at"),
        F.coalesce(_column(tours, "current_index", "int"), F.lit(0)).alias("current_index"),
    )


def full_address(address: Column, postal: Column) -> Column:
    return X.join_parts(", ", address, postal)


def map_query(name: Column, address: Column, postal: Column) -> Column:
    return X.join_parts(", ", name, address, postal)


def navigation_url(app: str, name: Column, address: Column, postal: Column) -> Column:
    """Where the chosen app finds the stop; null if navigation is off."""
    if app == "off":
        return F.lit(None).cast("string")
    if app == "google":
        return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), X.url_component(map_query(name, address, postal)))
    return F.concat(F.lit("https://waze.com/ul?q="), X.url_component(full_address(address, postal)), F.lit("&navigate=yes"))


def delivery_label(delivery_type: Column) -> Column:
    return F.coalesce(X.blank_to_null(delivery_type), F.lit("Nicht angegeben"))


def importable(stops: DataFrame) -> DataFrame:
    """Imported rows worth saving, with the flag for review."""
    some = X.join_parts("", F.col("name"), F.col("address"), F.col("postal")) != ""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return stops.where(some).withColumn("needs_review", blank("address") | blank("postal"))


def edit_stops(stops: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited texts replace old ones; id, status and source stay, the review only if the type is unchanged."""
    fields = ("name", "address", "postal", "delivery_type", "note")
    new = edits.select("tour_id", "stop_id", *(F.col(f).alias(f"__{f}") for f in fields))
    joined = stops.join(new, ["tour_id", "stop_id"], "left")
    review = F.when(F.col("__delivery_type").isNull() | (F.col("__delivery_type") == F.col("delivery_type")), F.col("delivery_review")).otherwise("")
    return joined.withColumn("delivery_review", review).select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in stops.columns))


def renumber(stops: DataFrame, *order: Column) -> DataFrame:
    """Positions from 0 without gaps, within each tour, in the given order (``pos`` by default)."""
    return stops.withColumn("pos", F.row_number().over(Window.partitionBy("tour_id").orderBy(*(order or (F.col("pos"),)))).cast("long") - 1)


def move(stops: DataFrame, stop_ids: Sequence, step: int) -> DataFrame:
    """Swap the named stops with their neighbours, up (-1) or down (1); at an end they stay."""
    window = Window.partitionBy("tour_id").orderBy("pos")
    moved = F.col("stop_id").isin(list(stop_ids))
    other = F.lag(moved, step).over(window)
    can = (F.lead("pos", 1) if step > 0 else F.lag("pos", 1)).over(window).isNotNull()
    swapped = F.when(moved & can, F.col("pos") + step).when(F.coalesce(other, F.lit(False)), F.col("pos") - step).otherwise(F.col("pos"))
    return stops.withColumn("pos", swapped)


def remove_stops(stops: DataFrame, gone: DataFrame) -> DataFrame:
    return renumber(stops.join(gone, ["tour_id", "stop_id"], "left_anti"))


def append_stops(stops: DataFrame, more: DataFrame) -> DataFrame:
    """New stops go behind the last of their tour."""
    tagged = stops.withColumn("__new", F.lit(0)).unionByName(more.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return renumber(tagged, F.col("__new"), F.col("pos")).drop("__new")


def duplicate_tours(stops: DataFrame, suffix: str = "-copy") -> DataFrame:
    """A second run of the same stops: new ids, all pending, notes kept."""
    return stops.withColumn("tour_id", F.concat(F.col("tour_id").cast("string"), F.lit(suffix))).withColumn("stop_id", F.concat(F.col("stop_id").cast("string"), F.lit(suffix))).withColumn("status", F.lit("pending"))


def reset_status(stops: DataFrame) -> DataFrame:
    out = stops.withColumn("status", F.lit("pending"))
    return out.withColumn("completed_at", F.lit(None).cast("timestamp")) if "completed_at" in stops.columns else out


def defer(stops: DataFrame, deferred: DataFrame) -> DataFrame:
    """Stops put off (``deferred(tour_id, stop_id, seq)``) become ``later`` and go to the end in order of ``seq``."""
    joined = stops.join(deferred.select("tour_id", "stop_id", F.col("seq").alias("__seq")), ["tour_id", "stop_id"], "left")
    out = joined.withColumn("status", F.when(F.col("__seq").isNotNull(), "later").otherwise(F.col("status")))
    return renumber(out, F.col("__seq").asc_nulls_first(), F.col("pos")).select(*stops.columns)
