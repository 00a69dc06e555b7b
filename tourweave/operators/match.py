"""Matching stops to geocoder candidates, and the cache of located addresses."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text as X

#: Two records further apart are not one building.
SAME_BUILDING_METRES = 120
CANDIDATE_LIMIT = 5
PLACES_MAX = 10_000
PATTERNS_MAX = 200


def label(name: Column, street: Column, house: Column, postal: Column, place: Column, country: Column) -> Column:
    return X.join_parts(", ", name, X.join_parts(" ", street, house), X.join_parts(" ", postal, place), country)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Valid, labelled candidates; of those at one point the first."""
    usable = candidates.where(geo.valid_point(F.col("lat"), F.col("lon")) & (F.coalesce("label", F.lit("")) != ""))
    first = F.row_number().over(Window.partitionBy("request_id", "lat", "lon").orderBy("cand_pos"))
    return usable.withColumn("__n", first).where("__n = 1").drop("__n")


def limit_candidates(candidates: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy("request_id").orderBy("cand_pos"))).where(F.col("__n") <= limit).drop("__n")


def confusable(a: Column, b: Column) -> Column:
    """Equally long keys of 8 letters or more that differ in one place, by letters that scans confuse."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    differing = F.aggregate(places, F.lit(0), lambda s, x: s + x)
    return (F.length(a) >= 8) & (F.length(a) == F.length(b)) & (X.confusable_key(a) == X.confusable_key(b)) & (differing == 1)


def automatic_matches(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One candidate per request, where exactly one building fits.

    ``requests(request_id, address, postal, country)``; ``candidates`` as from a geocoder.  House,
    postal code and country must be equal.  Streets must be equal or, where no equal one
    exists, all the confusable ones must be one street.  What fits must lie within
    ``SAME_BUILDING_METRES`` of each other; then an unnamed house wins, else an unnamed record,
    else the first.  The join is an equi-join on the request, house, postal code and the
    street's confusable form.
    """
    parts = X.split_address(F.col("address"))
    wanted = requests.select("request_id", F.upper(F.coalesce("country", F.lit(""))).alias("w_country"), X.street_key(parts["street"]).alias("w_street"), X.house_number(parts["house"]).alias("house_key"), X.postal_code(F.col("postal")).alias("postal_key"))
    wanted = wanted.where("house_key <> '' AND postal_key <> ''").withColumn("block", X.confusable_key(F.col("w_street")))
    offered = candidates.where(geo.valid_point(F.col("lat"), F.col("lon"))).withColumn("street_key", X.street_key(F.col("street")))
    offered = offered.withColumn("house_key", X.house_number(F.col("house"))).withColumn("postal_key", F.col("postal")).withColumn("block", X.confusable_key(F.col("street_key")))
    pairs = wanted.join(offered.drop("postal"), ["request_id", "house_key", "postal_key", "block"]).where((F.col("w_country") == "") | (F.upper(F.coalesce("country", F.lit(""))) == F.col("w_country")))
    exact = F.col("street_key") == F.col("w_street")
    pairs = pairs.withColumn("exact", exact).where(exact | confusable(F.col("w_street"), F.col("street_key")))
    request = Window.partitionBy("request_id")
    fitting = pairs.withColumn("any_exact", F.max("exact").over(request)).where("exact = any_exact")
    rank = F.when((F.col("kind") == "house") & (F.coalesce("name", F.lit("")) == ""), 0).when(F.coalesce("name", F.lit("")) == "", 1).otherwise(2)
    point = F.struct("lat", "lon")
    grouped = fitting.groupBy("request_id").agg(
        F.min(F.struct(rank.alias("rank"), F.col("cand_pos"), F.col("lat"), F.col("lon"))).alias("best"), F.max("any_exact").alias("exact"),
        F.count_distinct("street_key").alias("streets"), F.collect_set(point).alias("points"),
    )
    apart = F.exists("points", lambda a: F.exists("points", lambda b: geo.planar_metres(a["lat"], a["lon"], b["lat"], b["lon"]) > SAME_BUILDING_METRES))
    one = grouped.where((F.col("exact") | (F.col("streets") == 1)) & ~apart)
    return one.select("request_id", F.col("best.cand_pos").alias("cand_pos"), F.col("best.lat").alias("lat"), F.col("best.lon").alias("lon"), "exact")


def distinct_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One request for each address that the cache lacks, by the smallest id of those that have it: what a geocoder is asked."""
    keyed = _keyed(requests).join(cache.select("address_key"), "address_key", "left_anti")
    return keyed.groupBy("address_key").agg(F.min_by(F.struct(*requests.columns), "request_id").alias("r"), F.count("*").alias("n_requests")).select("r.*", "address_key", "n_requests")


def _keyed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("address_key", X.address_key(F.col("country"), F.col("address"), F.col("postal")))


def locate(requests: DataFrame, cache: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(located, fresh, unresolved)``: cache first, then manual choices, then automatic matches.

    Requests with one address are one question: candidates or a choice for any of them count for all (of several choices that
    for the smallest id).  ``fresh`` has a row for each address to append to the cache; requests without a place are all reported.
    """
    keyed = _keyed(requests)
    known = keyed.join(cache.select("address_key", "lat", "lon").dropDuplicates(["address_key"]), "address_key").select("request_id", "address_key", "lat", "lon", F.lit("cache").alias("origin"))
    misses = keyed.join(cache.select("address_key"), "address_key", "left_anti")
    asked = distinct_requests(requests, cache)
    leader = misses.select("request_id", "address_key").join(asked.select("address_key", F.col("request_id").alias("__asked")), "address_key")
    own = candidates.join(leader.select("request_id", "__asked"), "request_id").drop("request_id").withColumnRenamed("__asked", "request_id").dropDuplicates()
    found = automatic_matches(asked, own.select(*candidates.columns)).select("request_id", "lat", "lon", F.lit("match").alias("origin"))
    if overrides is not None:
        picked = overrides.join(leader, "request_id").groupBy("__asked").agg(F.min_by(F.struct("lat", "lon"), "request_id").alias("p"))
        chosen = picked.select(F.col("__asked").alias("request_id"), "p.lat", "p.lon", F.lit("manual").alias("origin"))
        found = chosen.unionByName(found.join(chosen.select("request_id"), "request_id", "left_anti"))
    fresh = asked.select("request_id", "address_key").join(found, "request_id").select("request_id", "address_key", "lat", "lon", "origin")
    fanned = misses.select("request_id", "address_key").join(fresh.drop("request_id"), "address_key").select("request_id", "address_key", "lat", "lon", "origin")
    return known.unionByName(fanned), fresh, misses.join(fanned.select("request_id"), "request_id", "left_anti")


def infer_postal(lines: DataFrame, places: DataFrame, text_col: str = "text") -> DataFrame:
    """The place of least ``priority`` whose name occurs in the text; ``places(pattern, postal, city, priority)`` is a small lookup table.

    Plain names are sought all at once, by one automaton that walks each line once; the few that are patterns are tried
    in order of priority.  Lines without a place drop out; each line keeps a row of its own.
    """
    rows = places.select("priority", "postal", "city", "pattern").limit(PLACES_MAX + 1).collect()
    if len(rows) > PLACES_MAX:
        raise ValueError(f"more than {PLACES_MAX} places")
    ranked = sorted(rows, key=lambda r: (r["priority"], r["postal"] or "", r["city"] or ""))
    plain = {}
    for i, r in enumerate(ranked):
        if not re.search(r"[\\^$.|?*+()\[\]{}]", r["pattern"]):
            plain.setdefault(r["pattern"], i)
    patterns = [(i, r["pattern"]) for i, r in enumerate(ranked) if r["pattern"] not in plain]
    if len(patterns) > PATTERNS_MAX:
        raise ValueError(f"more than {PATTERNS_MAX} places are patterns")
    shared = lines.sparkSession.sparkContext.broadcast(plain)

    @F.pandas_udf("int")
    def first_name(texts: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for name, i in shared.value.items():
            automaton.add_word(name, i)
        automaton.make_automaton()
        return pd.Series([min((i for _, i in automaton.iter(t)), default=None) for t in texts], dtype="Int32")

    text = F.lower(X.clean_line(F.col(text_col)))
    by_name = first_name(text) if plain else F.lit(None).cast("int")
    by_pattern = F.coalesce(*(F.when(text.rlike(p), F.lit(i)) for i, p in patterns), F.lit(None).cast("int")) if patterns else F.lit(None).cast("int")
    kept = [c for c in lines.columns if c != text_col]
    hit = lines.select(*kept, by_name.alias("__n"), by_pattern.alias("__p")).withColumn("__i", F.least("__n", "__p")).where("__i IS NOT NULL")
    table = F.array(*(F.struct(F.lit(r["postal"]).alias("postal"), F.lit(r["city"]).alias("city")) for r in ranked)) if len(ranked) <= PATTERNS_MAX else None
    if table is not None:
        return hit.withColumn("__r", F.element_at(table, F.col("__i") + 1)).select(*kept, "__r.postal", "__r.city")
    named = lines.sparkSession.createDataFrame([(i, r["postal"], r["city"]) for i, r in enumerate(ranked)], "__i int, postal string, city string")
    return hit.join(F.broadcast(named), "__i").select(*kept, "postal", "city")


def marker_groups(points: DataFrame) -> DataFrame:
    """Stops of a tour at exactly one point share a marker, in order of position."""
    groups = points.where(geo.valid_point(F.col("lat"), F.col("lon"))).groupBy("tour_id", "lat", "lon").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))).alias("stops"))
    return groups.select("tour_id", "lat", "lon", F.size("stops").cast("long").alias("n_stops"), F.col("stops")[0]["pos"].alias("first_pos"), F.transform("stops", lambda s: s["stop_id"]).alias("stop_ids"))


def bounds(points: DataFrame) -> DataFrame:
    valid = points.where(geo.valid_point(F.col("lat"), F.col("lon")))
    return valid.groupBy("tour_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
