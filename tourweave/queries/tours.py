"""Queries about tours and stops: statistics, records, keys, plans, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import geo, text as X
from ..operators import match, records, stats
from ..plans import routes
from ..sources import store

S = "WITH " + P.STOPS_SQL
SP = S + ", " + P.POINTS_SQL
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("tour_stats", S + """
SELECT tour_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'not_delivered') AS not_delivered,
       count(*) FILTER (status IN ('pending', 'later')) AS selectable,
       greatest(0, count(*) - count(*) FILTER (status IN ('done', 'not_delivered'))) AS open,
       count(*) > 0 AND count(*) = count(*) FILTER (status IN ('done', 'not_delivered')) AS completed,
       count(*) FILTER (status IN ('done', 'not_delivered'))::DOUBLE / count(*)::DOUBLE * 100 AS percent
FROM stops GROUP BY tour_id""")
def tour_stats(spark, d):
    return stats.tour_stats(P.stops(spark, d))


@query("tour_overview", S + """
SELECT tour_id, count(*) AS total, greatest(0, count(*) - count(*) FILTER (status IN ('done', 'not_delivered'))) AS open,
       max(updated_at) AS updated_at,
       coalesce(min(pos) FILTER (status IN ('pending', 'later')), -1)::BIGINT AS next_pos
FROM stops GROUP BY tour_id""")
def tour_overview(spark, d):
    stops = P.stops(spark, d)
    return stats.saved_tours(stops).join(stats.next_open(stops), "tour_id").select("tour_id", "total", "open", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "next_pos").orderBy(F.desc("updated_at"), "tour_id")


@query("next_open_stop", S + """
SELECT tour_id, CASE WHEN count(*) FILTER (status IN ('pending', 'later')) = 0 THEN -1
  ELSE coalesce(min(pos) FILTER (status IN ('pending', 'later') AND pos >= tour_id % 7), min(pos) FILTER (status IN ('pending', 'later'))) END::BIGINT AS next_pos
FROM stops GROUP BY tour_id""")
def next_open_stop(spark, d):
    return stats.next_open(P.stops(spark, d), F.col("tour_id") % 7)


@query("eligible_stops", S + "SELECT tour_id, pos, stop_id FROM stops WHERE status IN ('pending', 'later')")
def eligible_stops(spark, d):
    return stats.eligible(P.stops(spark, d), True).select("tour_id", "pos", "stop_id")


@query("missing_addresses", S + """
SELECT tour_id, min(pos) AS pos, arg_min(stop_id, pos) AS stop_id FROM stops
WHERE status IN ('pending', 'later') AND (trim(coalesce(address, '')) = '' OR trim(coalesce(postal, '')) = '') GROUP BY tour_id""")
def missing_addresses(spark, d):
    return stats.missing_address(P.stops(spark, d))


@query("normalized_stops", S + """
SELECT tour_id, pos, CAST(stop_id AS VARCHAR) AS stop_id, name, address, coalesce(postal, '') AS postal, delivery_type, '' AS delivery_review,
       '' AS delivery_source, note, status, CAST(NULL AS TIMESTAMP) AS completed_at, false AS needs_review FROM stops""")
def normalized_stops(spark, d):
    return records.normalize_stops(P.stops(spark, d)).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@query("full_addresses", S + """
SELECT stop_id, concat_ws(', ', nullif(address, ''), postal) AS full_address, concat_ws(', ', name, nullif(address, ''), postal) AS map_query,
       coalesce(nullif(delivery_type, ''), 'Nicht angegeben') AS label FROM stops""")
def full_addresses(spark, d):
    a, p = F.col("address"), F.col("postal")
    return P.stops(spark, d).select("stop_id", records.full_address(a, p).alias("full_address"), records.map_query(F.col("name"), a, p).alias("map_query"), records.delivery_label(F.col("delivery_type")).alias("label"))


@query("navigation_urls", S + """
SELECT stop_id, concat('https://waze.com/ul?q=', url_encode(concat_ws(', ', nullif(address, ''), postal)), '&navigate=yes') AS waze,
       concat('https://www.google.com/maps/search/?api=1&query=', url_encode(concat_ws(', ', name, nullif(address, ''), postal))) AS google FROM stops""")
def navigation_urls(spark, d):
    c = [F.col(x) for x in ("name", "address", "postal")]
    return P.stops(spark, d).select("stop_id", records.navigation_url("waze", *c).alias("waze"), records.navigation_url("google", *c).alias("google"))


@query("import_review", S + """
SELECT tour_id, pos, stop_id, (trim(coalesce(address, '')) = '' OR trim(coalesce(postal, '')) = '') AS needs_review
FROM stops WHERE name <> '' OR address <> '' OR postal <> ''""")
def import_review(spark, d):
    return records.importable(P.stops(spark, d)).select("tour_id", "pos", "stop_id", "needs_review")


@query("edited_stops", S + """
SELECT tour_id, pos, stop_id, CASE WHEN stop_id % 5 = 0 THEN 'Neu' ELSE delivery_type END AS delivery_type,
       CASE WHEN stop_id % 5 = 0 AND delivery_type <> 'Neu' THEN '' ELSE 'alt' END AS delivery_review,
       CASE WHEN stop_id % 5 = 0 THEN 'edit' ELSE note END AS note FROM stops""")
def edited_stops(spark, d):
    stops = P.stops(spark, d).withColumn("delivery_review", F.lit("alt"))
    edits = stops.where("stop_id % 5 = 0").withColumn("delivery_type", F.lit("Neu")).withColumn("note", F.lit("edit"))
    return records.edit_stops(stops, edits).select("tour_id", "pos", "stop_id", "delivery_type", "delivery_review", "note")


@query("deferred_stops", S + """
SELECT tour_id, stop_id, row_number() OVER (PARTITION BY tour_id ORDER BY CASE WHEN stop_id % 6 = 0 THEN stop_id END NULLS FIRST, pos) - 1 AS pos,
       CASE WHEN stop_id % 6 = 0 THEN 'later' ELSE status END AS status FROM stops""")
def deferred_stops(spark, d):
    stops = P.stops(spark, d)
    return records.defer(stops, stops.where("stop_id % 6 = 0").select("tour_id", "stop_id", F.col("stop_id").alias("seq"))).select("tour_id", "stop_id", "pos", "status")


@query("removed_stops", S + "SELECT tour_id, stop_id, row_number() OVER (PARTITION BY tour_id ORDER BY pos) - 1 AS pos FROM stops WHERE stop_id % 4 <> 1")
def removed_stops(spark, d):
    stops = P.stops(spark, d)
    return records.remove_stops(stops, stops.where("stop_id % 4 = 1").select("tour_id", "stop_id")).select("tour_id", "stop_id", "pos")


@query("appended_stops", S + """
SELECT tour_id, stop_id, row_number() OVER (PARTITION BY tour_id ORDER BY added, pos) - 1 AS pos FROM (
  SELECT tour_id, stop_id, pos, 0 AS added FROM stops UNION ALL SELECT tour_id, -stop_id, pos, 1 FROM stops WHERE stop_id % 8 = 2)""")
def appended_stops(spark, d):
    stops = P.stops(spark, d)
    return records.append_stops(stops, stops.where("stop_id % 8 = 2").withColumn("stop_id", -F.col("stop_id"))).select("tour_id", "stop_id", "pos")


@query("duplicated_tours", S + """
SELECT concat(CAST(tour_id AS VARCHAR), '-copy') AS tour_id, concat(CAST(stop_id AS VARCHAR), '-copy') AS stop_id, pos, note, 'pending' AS status FROM stops""")
def duplicated_tours(spark, d):
    return records.duplicate_tours(P.stops(spark, d)).select("tour_id", "stop_id", "pos", "note", "status")


@query("reset_tours", S + "SELECT tour_id, stop_id, 'pending' AS status FROM stops")
def reset_tours(spark, d):
    return records.reset_status(P.stops(spark, d)).select("tour_id", "stop_id", "status")


@query("moved_stops", S + """, m AS (SELECT *, min(CASE WHEN stop_id % 3 = 0 THEN pos END) OVER (PARTITION BY tour_id) AS first, max(pos) OVER (PARTITION BY tour_id) AS last FROM stops)
SELECT tour_id, stop_id, CASE WHEN pos = first AND first < last THEN pos + 1 WHEN pos = first + 1 THEN pos - 1 ELSE pos END AS pos FROM m""")
def moved_stops(spark, d):
    """The first stop of each tour whose id is divisible by 3 changes places with the next."""
    from pyspark.sql import Window

    stops = P.stops(spark, d)
    tour = Window.partitionBy("tour_id")
    first = F.min(F.when(F.col("stop_id") % 3 == 0, F.col("pos"))).over(tour)
    marked = stops.withColumn("first", first).withColumn("last", F.max("pos").over(tour))
    pos = F.when((F.col("pos") == F.col("first")) & (F.col("first") < F.col("last")), F.col("pos") + 1).when(F.col("pos") == F.col("first") + 1, F.col("pos") - 1).otherwise(F.col("pos"))
    return marked.select("tour_id", "stop_id", pos.alias("pos"))


NORMAL = "regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[^a-z0-9]', '', 'g')"
STREET = "regexp_replace(" + NORMAL.format("replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')") + ", 'str$', 'strasse')"
SPLIT = r"regexp_extract({0}, '(?i)^(.*?)\s+(\d+\s*[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?)$', {1})"


@query("address_parts", S + f"""
SELECT stop_id, {SPLIT.format('address', 1)} AS street, {SPLIT.format('address', 2)} AS house, {STREET.format(SPLIT.format('address', 1))} AS street_key,
       regexp_replace(lower({SPLIT.format('address', 2)}), '\\s+', '', 'g') AS house_key, regexp_extract(coalesce(postal, ''), '\\b\\d{{4,5}}\\b') AS postal_code,
       {NORMAL.format('address')} AS plain FROM stops""")
def address_parts(spark, d):
    parts = X.split_address(F.col("address"))
    stops = P.stops(spark, d).withColumn("s", parts)
    return stops.select("stop_id", "s.street", "s.house", X.street_key(F.col("s.street")).alias("street_key"), X.house_number(F.col("s.house")).alias("house_key"), X.postal_code(F.col("postal")).alias("postal_code"), X.plain_letters(F.col("address")).alias("plain"))


KEY = "to_json(['AT', lower(trim(regexp_replace(address, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(coalesce(postal, ''), '\\s+', ' ', 'g')))])"


@query("address_keys", S + f"SELECT {KEY}::VARCHAR AS address_key, count(*) AS n_stops, count(DISTINCT tour_id) AS n_tours FROM stops GROUP BY 1")
def address_keys(spark, d):
    key = X.address_key(F.lit("AT"), F.col("address"), F.col("postal"))
    return P.stops(spark, d).groupBy(key.alias("address_key")).agg(F.count("*").alias("n_stops"), F.count_distinct("tour_id").alias("n_tours"))


#: Stops with the fields that only fingerprints need: notes of reviews, sources, times of completion.
REVIEWED_SQL = """, reviewed AS (SELECT *, CASE WHEN stop_id % 10 = 0 THEN 'bitte prüfen' ELSE '' END AS delivery_review, CASE WHEN stop_id % 6 = 0 THEN 'pdf' ELSE '' END AS delivery_source,
  CASE WHEN status IN ('done', 'not_delivered') THEN concat('2024-01-0', CAST(stop_id % 9 + 1 AS VARCHAR), 'T10:00:00.000Z') END AS completed_at FROM stops)
"""
#: The fingerprint as the original states it: id and ten fields of each stop, in this order.
FINGERPRINT_SQL = """sha256(to_json({'id': CAST(tour_id AS VARCHAR), 'stops': list([CAST(stop_id AS VARCHAR), name, address, coalesce(postal, ''), status, note, completed_at, delivery_type, delivery_review, delivery_source] ORDER BY pos)})::VARCHAR)"""


def reviewed(spark, d):
    k, done = F.col("stop_id"), F.col("status").isin("done", "not_delivered")
    return P.stops(spark, d).select(
        "*", F.when(k % 10 == 0, "bitte prüfen").otherwise("").alias("delivery_review"), F.when(k % 6 == 0, "pdf").otherwise("").alias("delivery_source"),
        F.when(done, F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00.000Z"))).alias("completed_at"),
    )


@query("tour_keys", S + REVIEWED_SQL + f"""
SELECT tour_id, to_json(list([CAST(stop_id AS VARCHAR), name, address, coalesce(postal, '')] ORDER BY pos))::VARCHAR AS tour_key, {FINGERPRINT_SQL} AS fingerprint FROM reviewed GROUP BY tour_id""")
def tour_keys(spark, d):
    return routes.tour_keys(reviewed(spark, d))


@query("marker_groups", SP + """
SELECT tour_id, lat, lon, count(*) AS n_stops, min(pos) AS first_pos, list(stop_id ORDER BY pos) AS stop_ids FROM points WHERE abs(lat) <= 90 GROUP BY ALL""")
def marker_groups(spark, d):
    return match.marker_groups(P.points(spark, d))


@query("map_bounds", SP + "SELECT tour_id, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM points WHERE abs(lat) <= 90 GROUP BY tour_id")
def map_bounds(spark, d):
    return match.bounds(P.points(spark, d))


@query("valid_points", SP + "SELECT stop_id, abs(lat) <= 90 AND abs(lon) <= 180 AS valid FROM points")
def valid_points(spark, d):
    return P.points(spark, d).select("stop_id", geo.valid_point(F.col("lat"), F.col("lon")).alias("valid"))


@query("leg_distances", SP + """, l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WHERE abs(lat) <= 90 WINDOW w AS (PARTITION BY tour_id ORDER BY pos))
SELECT stop_id, CAST(floor(sqrt(((lat - lat2) * 111320) ** 2 + ((lon - lon2) * 111320 * cos(radians((lat + lat2) / 2))) ** 2) + 0.5) AS BIGINT) AS metres FROM l WHERE lat2 IS NOT NULL""")
def leg_distances(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("tour_id").orderBy("pos")
    legs = P.points(spark, d).where(geo.valid_point(F.col("lat"), F.col("lon"))).withColumn("lat2", F.lead("lat").over(w)).withColumn("lon2", F.lead("lon").over(w)).where("lat2 IS NOT NULL")
    return legs.select("stop_id", F.floor(geo.planar_metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) + 0.5).alias("metres"))


# --- geocoder candidates: five a stop, made from the stop with one thing changed --------------------
CANDIDATES_SQL = r"""
cand AS (
  SELECT s.stop_id AS request_id, k AS cand_pos,
    CAST(48000000 + (s.stop_id * 7919) % 400 * 100 + CASE WHEN k = 3 THEN (s.stop_id % 3) * 10000 ELSE k // 2 * 100 END AS DOUBLE) / 1000000 AS lat,
    CAST(15000000 + (s.stop_id * 104729) % 300 * 100 AS DOUBLE) / 1000000 AS lon,
    CASE WHEN k = 2 AND s.stop_id % 2 = 0 THEN 'Anderer Weg' WHEN s.stop_id % 17 = 0 THEN replace(""" + SPLIT.format("address", 1) + r""", 'Linden', 'Llnden') ELSE """ + SPLIT.format("address", 1) + r""" END AS street,
    CASE WHEN k = 4 THEN '999' ELSE """ + SPLIT.format("address", 2) + r""" END AS house,
    CASE WHEN k = 1 AND s.stop_id % 3 = 0 THEN '9999' ELSE substr(postal, 1, 4) END AS postal_code,
    CASE WHEN k = 0 AND s.stop_id % 4 = 0 THEN 'DE' ELSE 'AT' END AS country, CASE WHEN k = 1 THEN 'house' ELSE 'shop' END AS kind,
    CASE WHEN k = 0 THEN 'Laden' ELSE '' END AS name, concat('c', CAST(k AS VARCHAR)) AS label
  FROM stops s, unnest(range(5)) AS t(k) WHERE address <> '' AND postal IS NOT NULL)
"""


def candidates(spark, d):
    stops = P.stops(spark, d).where("address <> '' AND postal IS NOT NULL")
    parts = X.split_address(F.col("address"))
    rows = stops.withColumn("s", parts).select("stop_id", "s", "postal", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    k, key, street = F.col("k"), F.col("stop_id"), F.col("s.street")
    north = F.when(k == 3, key % 3 * 10_000).otherwise(F.floor(k / 2) * 100)
    return rows.select(
        key.alias("request_id"), k.alias("cand_pos"), ((48_000_000 + (key * 7919) % 400 * 100 + north).cast("double") / 1_000_000).alias("lat"), ((15_000_000 + (key * 104729) % 300 * 100).cast("double") / 1_000_000).alias("lon"),
        F.when((k == 2) & (key % 2 == 0), "Anderer Weg").when(key % 17 == 0, F.replace(street, F.lit("Linden"), F.lit("Llnden"))).otherwise(street).alias("street"),
        F.when(k == 4, "999").otherwise(F.col("s.house")).alias("house"), F.when((k == 1) & (key % 3 == 0), "9999").otherwise(F.substring("postal", 1, 4)).alias("postal"),
        F.when((k == 0) & (key % 4 == 0), "DE").otherwise("AT").alias("country"), F.when(k == 1, "house").otherwise("shop").alias("kind"), F.when(k == 0, "Laden").otherwise("").alias("name"), F.concat(F.lit("c"), k.cast("string")).alias("label"),
    )


@query("distinct_candidates", S + "," + CANDIDATES_SQL + "SELECT request_id, lat, lon, min(cand_pos) AS cand_pos FROM cand GROUP BY 1, 2, 3")
def distinct_candidates(spark, d):
    return match.distinct_candidates(candidates(spark, d)).select("request_id", "lat", "lon", F.col("cand_pos").cast("long").alias("cand_pos"))


@query("automatic_matches", S + "," + CANDIDATES_SQL + f""", p AS (
  SELECT c.*, {STREET.format(SPLIT.format('s.address', 1))} AS ws, {STREET.format('c.street')} AS cs FROM cand c JOIN stops s ON s.stop_id = c.request_id
  WHERE regexp_replace(lower(c.house), '\\s+', '', 'g') = regexp_replace(lower({SPLIT.format('s.address', 2)}), '\\s+', '', 'g') AND c.postal_code = substr(s.postal, 1, 4) AND c.country = 'AT'
), q AS (SELECT *, cs = ws AS exact FROM p WHERE cs = ws OR (length(cs) >= 8 AND length(cs) = length(ws) AND translate(cs, 'l10', 'iio') = translate(ws, 'l10', 'iio') AND hamming(cs, ws) = 1)
), r AS (SELECT *, bool_or(exact) OVER (PARTITION BY request_id) AS any_exact FROM q), f AS (SELECT * FROM r WHERE exact = any_exact
), ok AS (SELECT a.request_id FROM f a JOIN f b USING (request_id) GROUP BY a.request_id
  HAVING max(sqrt(((a.lat - b.lat) * 111320) ** 2 + ((a.lon - b.lon) * 111320 * cos(radians((a.lat + b.lat) / 2))) ** 2)) <= 120 AND (bool_or(a.exact) OR count(DISTINCT a.cs) = 1))
SELECT request_id, arg_min(cand_pos, rank * 10 + cand_pos)::BIGINT AS cand_pos, bool_or(any_exact) AS exact FROM (
  SELECT *, CASE WHEN kind = 'house' AND name = '' THEN 0 WHEN name = '' THEN 1 ELSE 2 END AS rank FROM f) WHERE request_id IN (FROM ok) GROUP BY request_id""")
def automatic_matches(spark, d):
    requests = P.stops(spark, d).select(F.col("stop_id").alias("request_id"), "address", "postal", F.lit("AT").alias("country"))
    return match.automatic_matches(requests, candidates(spark, d)).select("request_id", F.col("cand_pos").cast("long").alias("cand_pos"), "exact")


@query("cached_locations", S + f"""
, keyed AS (SELECT stop_id, {KEY}::VARCHAR AS k FROM stops WHERE address <> ''), cache AS (SELECT DISTINCT k FROM keyed WHERE stop_id % 2 = 0)
SELECT stop_id AS request_id, k IN (FROM cache) AS cached FROM keyed""")
def cached_locations(spark, d):
    """Which requests the cache of the even stops' addresses answers."""
    stops = P.stops(spark, d).where("address <> ''").select(F.col("stop_id").alias("request_id"), "address", "postal", F.lit("AT").alias("country"))
    cache = stops.where("request_id % 2 = 0").select(X.address_key(F.col("country"), F.col("address"), F.col("postal")).alias("address_key"), F.lit(48.0).alias("lat"), F.lit(15.0).alias("lon"))
    located, _, unresolved = match.locate(stops, cache, candidates(spark, d).where("false"))
    return located.select("request_id", F.lit(True).alias("cached")).unionByName(unresolved.select("request_id", F.lit(False).alias("cached")))


@query("asked_addresses", S + f"""
, keyed AS (SELECT stop_id, {KEY}::VARCHAR AS k FROM stops WHERE address <> ''), cache AS (SELECT DISTINCT k FROM keyed WHERE stop_id % 64 = 0)
SELECT min(stop_id) AS request_id, count(*) AS n_requests FROM keyed WHERE k NOT IN (FROM cache) GROUP BY k""")
def asked_addresses(spark, d):
    """One question for each address that the cache of some stops lacks."""
    stops = P.stops(spark, d).where("address <> ''").select(F.col("stop_id").alias("request_id"), "address", "postal", F.lit("AT").alias("country"))
    cache = stops.where("request_id % 64 = 0").select(X.address_key(F.col("country"), F.col("address"), F.col("postal")).alias("address_key")).distinct()
    return match.distinct_requests(stops, cache).select("request_id", "n_requests")


# --- plans: the order by a hash of the stop, faster or slower by the tour ---------------------------
ANSWERS_SQL = """
ranked AS (SELECT tour_id, pos, CASE WHEN pos = 0 THEN 0 ELSE row_number() OVER (PARTITION BY tour_id ORDER BY pos > 0, (stop_id * 7919) % 1009, stop_id) - 1 END AS rank FROM stops),
plan AS (SELECT tour_id, count(*) AS n, list(pos ORDER BY rank) AS by_rank, tour_id % 5 <> 0 AS faster, 1000 + tour_id % 100 AS base, CASE WHEN tour_id % 5 = 0 THEN 2000 ELSE 900 END AS trip, tour_id % 11 = 3 AS bad FROM ranked GROUP BY tour_id)
"""


def answers(spark, d):
    from pyspark.sql import Window

    key = F.col("stop_id")
    hashed = Window.partitionBy("tour_id").orderBy(F.col("pos") > 0, (key * 7919) % 1009, key)
    ranks = P.stops(spark, d).withColumn("rank", (F.row_number().over(hashed) - 1).cast("int"))
    tours = ranks.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"]).alias("ranks"))
    n, t = F.size("ranks"), F.col("tour_id")
    route = lambda seconds: F.array(F.struct(seconds.cast("double").alias("duration"), F.lit(5000.0).alias("distance"), (n - 1).alias("n_legs")))
    snap = F.when(t % 11 == 3, 2000.0).otherwise(3.0)
    points = F.transform("ranks", lambda r: F.struct(r.alias("waypoint_index"), F.lit(0).alias("trips_index"), snap.alias("distance")))
    trip = F.struct(F.lit("Ok").alias("code"), route(F.when(t % 5 == 0, 2000).otherwise(900)).alias("trips"), points.alias("waypoints"))
    base = F.struct(F.lit("Ok").alias("code"), route(1000 + t % 100).alias("routes"), F.transform("ranks", lambda r: F.struct(F.lit(3.0).alias("distance"))).alias("waypoints"))
    return tours.select(t.alias("plan_id"), n.alias("n"), trip.alias("trip"), base.alias("baseline"))


@query("selected_plans", S + "," + ANSWERS_SQL + """
SELECT tour_id AS plan_id, CASE WHEN n < 2 THEN 'bad_size' WHEN bad THEN 'too_far_from_road' END AS error,
       CASE WHEN n < 2 OR bad THEN NULL WHEN faster THEN by_rank ELSE range(n) END::INTEGER[] AS "order",
       CASE WHEN n < 2 OR bad THEN NULL WHEN faster THEN base - trip ELSE 0 END::DOUBLE AS saved_seconds FROM plan""")
def selected_plans(spark, d):
    return routes.select_plans(answers(spark, d)).select("plan_id", "error", "order", "saved_seconds")


@query("reordered_tours", S + """
, sel AS (SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY pos) AS slot, row_number() OVER (PARTITION BY tour_id ORDER BY (stop_id * 7919) % 1009, stop_id) AS rank FROM stops WHERE status IN ('pending', 'later') AND tour_id % 3 <> 0),
moved AS (SELECT a.tour_id, a.stop_id, b.pos FROM sel a JOIN sel b ON a.tour_id = b.tour_id AND a.rank = b.slot)
SELECT tour_id, stop_id, coalesce(moved.pos, stops.pos) AS pos FROM stops LEFT JOIN moved USING (tour_id, stop_id)""")
def reordered_tours(spark, d):
    """Open stops in hashed order; every third tour's order names a stop too many and changes nothing."""
    stops = P.stops(spark, d)
    key = F.col("stop_id")
    chosen = stats.eligible(stops, True).groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(((key * 7919) % 1009).alias("h"), key))), lambda x: x["stop_id"]).alias("ids"))
    orders = chosen.withColumn("ids", F.when(F.col("tour_id") % 3 == 0, F.concat("ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("ids")))
    return routes.reorder(stops, orders)[0].select("tour_id", "stop_id", "pos")


@query("reorder_errors", S + """
SELECT tour_id, CASE tour_id % 3 WHEN 0 THEN 'tour_changed' ELSE 'status_changed' END AS error FROM stops GROUP BY tour_id
HAVING tour_id % 3 = 0 OR (tour_id % 3 = 1 AND bool_or(status NOT IN ('pending', 'later')))""")
def reorder_errors(spark, d):
    stops = P.stops(spark, d)
    ids = stops.groupBy("tour_id").agg(F.collect_list("stop_id").alias("ids"), F.collect_list(F.when(stats.is_open(F.col("status")), F.col("stop_id"))).alias("open"))
    t = F.col("tour_id") % 3
    orders = ids.select("tour_id", F.when(t == 0, F.concat("ids", F.array(F.col("ids")[0]))).when(t == 1, F.col("ids")).otherwise(F.col("open")).alias("ids"))
    return routes.reorder(stops, orders)[1]


@query("undo_states", S + """
SELECT tour_id, CASE tour_id % 3 WHEN 0 THEN true WHEN 1 THEN count(*) = 1 ELSE false END AS available FROM stops GROUP BY tour_id""")
def undo_states(spark, d):
    current = P.stops(spark, d).groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("ids"))
    back = F.reverse("ids")
    t = F.col("tour_id") % 3
    before = F.when(t == 2, F.concat("ids", F.array(F.lit(-1).cast("long")))).otherwise(back)
    after = F.when(t == 1, back).otherwise(F.col("ids"))
    return current.select("tour_id", routes.undo_available(F.col("ids"), before, after).alias("available"))


@query("undone_tours", S + "SELECT tour_id, stop_id, max(pos) OVER (PARTITION BY tour_id) - pos AS pos FROM stops")
def undone_tours(spark, d):
    stops = P.stops(spark, d)
    current = stops.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("after"))
    return routes.undo(stops, current.withColumn("before", F.reverse("after"))).select("tour_id", "stop_id", "pos")


@query("committed_tours", S + REVIEWED_SQL + f""", old AS (SELECT tour_id, {FINGERPRINT_SQL} AS f FROM reviewed GROUP BY tour_id),
later AS (SELECT * REPLACE (CASE WHEN tour_id % 4 = 1 AND pos = 0 THEN 'x' ELSE delivery_review END AS delivery_review, CASE WHEN tour_id % 4 = 2 AND pos = 0 THEN 'x' ELSE delivery_source END AS delivery_source,
  CASE WHEN tour_id % 4 = 3 AND pos = 0 THEN '2025-01-01T00:00:00.000Z' ELSE completed_at END AS completed_at) FROM reviewed),
now AS (SELECT tour_id, {FINGERPRINT_SQL} AS g FROM later GROUP BY tour_id)
SELECT tour_id, stop_id, CASE WHEN f <> g OR bool_or(status NOT IN ('pending', 'later')) OVER (PARTITION BY tour_id) THEN pos ELSE max(pos) OVER (PARTITION BY tour_id) - pos END AS pos
FROM later JOIN old USING (tour_id) JOIN now USING (tour_id)""")
def committed_tours(spark, d):
    """All stops reversed.  Of four tours one is as it was; the others had a review note, a source or a
    time of completion changed meanwhile.  Tours with closed stops are refused."""
    before = reviewed(spark, d)
    first = lambda r: (F.col("tour_id") % 4 == r) & (F.col("pos") == 0)
    now = before.withColumns({
        "delivery_review": F.when(first(1), "x").otherwise(F.col("delivery_review")),
        "delivery_source": F.when(first(2), "x").otherwise(F.col("delivery_source")),
        "completed_at": F.when(first(3), "2025-01-01T00:00:00.000Z").otherwise(F.col("completed_at")),
    })
    orders = now.groupBy("tour_id").agg(F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"])).alias("ids"))
    return routes.commit_orders(now, orders, routes.tour_keys(before).select("tour_id", "fingerprint"))[0].select("tour_id", "stop_id", "pos")


@query("visit_numbers", S + "," + ANSWERS_SQL + """
SELECT p.tour_id AS snapshot_id, i - 1 AS rank, by_rank[i] AS point, CASE WHEN p.tour_id % 2 = 0 THEN CAST(i AS VARCHAR) WHEN i = 1 THEN 'S' ELSE CAST(i - 1 AS VARCHAR) END AS label,
       i = 1 AS is_start, i = n AS is_end FROM plan p, unnest(range(1, n + 1)) AS t(i)""")
def visit_numbers(spark, d):
    """Snapshots of all tours in hashed order; odd tours start from a place of their own."""
    tours = answers(spark, d).select("plan_id", F.col("trip.waypoints").alias("w"))
    order = F.transform(F.array_sort(F.transform("w", lambda w, i: F.struct(w["waypoint_index"].alias("rank"), i.alias("input")))), lambda x: x["input"])
    ids = F.transform("w", lambda w, i: F.when((F.col("plan_id") % 2 == 1) & (i == 0), F.lit(None)).otherwise(i.cast("string")))
    shots = tours.select(F.col("plan_id").alias("snapshot_id"), order.alias("order"), ids.alias("ids"))
    ranked = routes.visits(shots).join(shots.select("snapshot_id", F.posexplode("order").alias("rank", "point")), ["snapshot_id", "point"])
    return ranked.select("snapshot_id", F.col("rank").cast("long").alias("rank"), F.col("point").cast("long").alias("point"), "label", "is_start", "is_end")


@query("valid_snapshots", S + "SELECT tour_id, count(*) BETWEEN 2 AND 81 AND tour_id % 7 <> 0 AS valid FROM stops GROUP BY tour_id")
def valid_snapshots(spark, d):
    shots = P.stops(spark, d).groupBy("tour_id").agg(F.sort_array(F.collect_list("stop_id")).alias("ids"))
    points = F.transform("ids", lambda i: F.struct(F.lit(48.0).alias("lat"), F.lit(15.0).alias("lon"), i.cast("string").alias("id")))
    order = F.sequence(F.lit(0), F.size("ids") - 1).cast("array<int>")
    metric = lambda x: F.struct(x.alias("duration"), F.lit(1.0).alias("distance"))
    broken = F.when(F.col("tour_id") % 7 == 0, -1.0).otherwise(1.0)
    return shots.select("tour_id", routes.valid_snapshot(F.lit(1), order, points, metric(F.lit(1.0)), metric(broken)).alias("valid"))


# --- sources and sinks -------------------------------------------------------------------------------
QUOTE = """'"' || replace(coalesce({0}, ''), '"', '""') || '"'"""


@query("csv_export", S + f"""
SELECT DISTINCT tour_id, 0::BIGINT AS line_no, '"Nr";"Kunde";"Adresse";"PLZ Ort";"Lieferart";"Status";"Notiz"' AS line FROM stops UNION ALL
SELECT tour_id, pos + 1, concat_ws(';', {', '.join(QUOTE.format(c) for c in ("CAST(pos + 1 AS VARCHAR)", "name", "address", "postal", "coalesce(nullif(delivery_type, ''), 'Nicht angegeben')", "status", "note"))}) FROM stops""")
def csv_export(spark, d):
    return store.csv_lines(P.stops(spark, d))


@query("backup_restore", S + """
SELECT CAST(tour_id AS VARCHAR) AS old_id, tour_id % 4 <> 0 AS kept_id, count(*) AS n_stops, string_agg(CAST(stop_id AS VARCHAR), ',' ORDER BY pos) AS stop_ids FROM stops GROUP BY tour_id""")
def backup_restore(spark, d):
    """Written as JSON, read back next to every fourth tour: only those get new ids."""
    stops = P.stops(spark, d)
    tours = stops.select(F.col("tour_id")).distinct().withColumn("name", F.lit("Tour"))
    documents = store.backup(tours, stops).select(F.regexp_replace("document", r'"tour_id":(\d+)', '"tour_id":"$1"').alias("document"))
    back = store.restore(documents, tours.where("tour_id % 4 = 0"))
    return back.select("old_id", (F.col("tour_id") == F.col("old_id")).alias("kept_id"), F.size("stops").cast("long").alias("n_stops"), F.array_join(F.transform("stops", lambda s: s["stop_id"]), ",").alias("stop_ids"))


@query("upserted_tours", S + """
SELECT stop_id, CASE WHEN stop_id % 2 = 0 THEN 'new' ELSE status END AS status FROM stops WHERE stop_id % 3 <> 0 UNION ALL SELECT -stop_id, 'new' FROM stops WHERE stop_id % 50 = 0 AND stop_id > 0""")
def upserted_tours(spark, d):
    old = P.stops(spark, d).select("stop_id", "status")
    new = old.where("stop_id % 2 = 0").unionByName(old.where("stop_id % 50 = 0").withColumn("stop_id", -F.col("stop_id"))).withColumn("status", F.lit("new"))
    return store.delete(store.upsert(old, new, "stop_id"), old.where("stop_id % 3 = 0"), "stop_id")


@query("meta_lookup", "SELECT (SELECT min(c_custkey)::VARCHAR FROM customer) AS current, CAST(NULL AS VARCHAR) AS missing")
def meta_lookup(spark, d):
    meta = P.table(spark, d, "customer").agg(F.lit("currentTourId").alias("key"), F.min("c_custkey").cast("string").alias("value"))
    return store.meta_values(meta, current="currentTourId", missing="autoNav")


@query("file_names", "SELECT p_partkey, regexp_replace(p_name || '/ä ß', '(?i)[^a-z0-9äöüß_-]+', '_', 'g') AS file_name FROM part")
def file_names(spark, d):
    return P.table(spark, d, "part").select("p_partkey", store.file_name(F.concat("p_name", F.lit("/ä ß"))).alias("file_name"))


@query("driving_times", """
SELECT o_orderkey, CASE WHEN m < 1 THEN '< 1 Min.' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' Min.' ELSE CAST(m // 60 AS VARCHAR) || ' Std. ' || CAST(m % 60 AS VARCHAR) || ' Min.' END AS driving_time,
  replace(regexp_replace(format('{:,}', km // 10), ',', chr(160), 'g') || CASE WHEN km % 10 = 0 THEN '' ELSE ',' || CAST(km % 10 AS VARCHAR) END, ' ', '') AS km
FROM (SELECT o_orderkey, (o_orderkey % 20000 + 30) // 60 AS m, ((o_orderkey * 7919) % 3000000 + 50) // 100 AS km FROM orders)""")
def driving_times(spark, d):
    key = F.col("o_orderkey")
    return P.table(spark, d, "orders").select("o_orderkey", X.driving_time(key % 20_000).alias("driving_time"), X.kilometres((key * 7919) % 3_000_000).alias("km"))


@query("router_requests", SP + """
SELECT tour_id AS plan_id, concat('r/trip/v1/driving/', p, '?source=first&destination=any&roundtrip=false&overview=full&geometries=geojson&steps=false') AS trip,
       concat('r/route/v1/driving/', p, '?overview=full&geometries=geojson&steps=false') AS route
FROM (SELECT tour_id, string_agg(printf('%.6f,%.6f', lon, lat), ';' ORDER BY pos) AS p, count(*) AS n, bool_and(abs(lat) <= 90) AS fine FROM points GROUP BY tour_id) WHERE fine AND n BETWEEN 2 AND 81""")
def router_requests(spark, d):
    return store.router_requests(P.points(spark, d), "r")


@query("geocoder_requests", S + "SELECT stop_id AS request_id, concat('g?q=', url_encode(concat_ws(', ', nullif(address, ''), postal)), '&lang=de&limit=5&countrycode=AT') AS body FROM stops")
def geocoder_requests(spark, d):
    return store.geocoder_requests(P.stops(spark, d), "g", "AT")
