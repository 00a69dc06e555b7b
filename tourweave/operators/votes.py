"""Evidence from several reads of one cell: votes that agree or say so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A single read below this confidence decides nothing.
SURE = 55


def count_votes(votes: DataFrame) -> DataFrame:
    """``votes(stop_id, pos, value, confidence)`` -> per stop the votes by value.

    ``choice`` is the value if all reads agree, and null if they conflict; ``uncertain`` marks a
    lone read of low confidence; ``ranking`` lists the values, most votes first, ties by first
    appearance.  Both levels combine before the shuffle.
    """
    by_value = votes.where("value IS NOT NULL").groupBy("stop_id", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min(F.coalesce("confidence", F.lit(100.0))).alias("low"))
    entry = F.struct((-F.col("n")).alias("order"), "first", "value")
    out = by_value.groupBy("stop_id").agg(F.sum("n").alias("n_votes"), F.count("*").alias("n_values"), F.min("low").alias("min_confidence"), F.array_sort(F.collect_list(entry)).alias("entries"))
    choice = F.when(F.col("n_values") == 1, F.col("entries")[0]["value"])
    lone = (F.col("n_values") == 1) & (F.col("n_votes") == 1) & (F.col("min_confidence") < SURE)
    return out.select("stop_id", "n_votes", "n_values", choice.alias("choice"), lone.alias("uncertain"), F.least(F.lit(100.0), F.col("min_confidence")).alias("min_confidence"), F.transform("entries", lambda e: e["value"]).alias("ranking"))


def check_companions(stops: DataFrame, companions: DataFrame) -> DataFrame:
    """The first companion number that differs from a stop's own number.

    With a pair as evidence it is a warning, otherwise the number is withheld:
    ``stops(stop_id, number, has_pair)``, ``companions(stop_id, pos, number)``.
    """
    other = companions.withColumnRenamed("number", "__other")
    differing = stops.join(other, "stop_id").where(F.col("__other") != F.col("number")).groupBy("stop_id").agg(F.min_by("__other", "pos").alias("companion"))
    joined = stops.join(differing, "stop_id", "left")
    verdict = F.when(F.col("companion").isNull(), "ok").when(F.col("has_pair"), "warn").otherwise("blocked")
    return joined.select("stop_id", F.when(verdict != "blocked", F.col("number")).alias("number"), "companion", verdict.alias("verdict"))
