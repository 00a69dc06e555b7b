"""Queries about plans that are applied, evidence that is fused, pages that are laid out, and pixels.

Where a result follows from how its input is made, the SQL states it from there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import geo, lines
from ..operators import layout as Y, match, pages, raster, records, rereads, stats
from ..plans import routes
from ..sources import store
from .pages import WORDS_SQL, words
from .tours import ANSWERS_SQL, answers

S = "WITH " + P.STOPS_SQL
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- plans ------------------------------------------------------------------------------------------
#: The open stops of a tour in reverse, in the slots they had; the current stop is at tour_id modulo the tour's size.
APPLIED_SQL = """,
o AS (SELECT tour_id, pos, stop_id, status IN ('pending', 'later') AS open, row_number() OVER w AS r, count(*) OVER (PARTITION BY tour_id, status IN ('pending', 'later')) AS m
      FROM stops WINDOW w AS (PARTITION BY tour_id, status IN ('pending', 'later') ORDER BY pos)),
a AS (SELECT x.tour_id, x.pos, y.stop_id, x.open FROM o x JOIN o y ON x.tour_id = y.tour_id AND x.open = y.open AND y.r = CASE WHEN x.open THEN x.m - x.r + 1 ELSE x.r END),
t AS (SELECT tour_id, count(*) AS n, list(stop_id ORDER BY pos) AS before, count(*) FILTER (open) > 1 AS changed, min(pos) FILTER (open) AS first, list(pos ORDER BY pos) FILTER (open) AS opens FROM o GROUP BY tour_id),
after AS (SELECT tour_id, list(stop_id ORDER BY pos) AS after FROM a GROUP BY tour_id)
"""


def tours_and_orders(spark, d):
    stops = P.stops(spark, d)
    tours = stops.groupBy("tour_id").agg(F.count("*").alias("n")).select("tour_id", (F.col("tour_id") % F.col("n")).cast("int").alias("current_index"), F.lit(None).cast("struct<before:array<bigint>,after:array<bigint>,current:bigint>").alias("undo"))
    ids = F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]))
    return tours, stops, stats.eligible(stops, True).groupBy("tour_id").agg(ids.alias("ids"))


@query("applied_plans", S + APPLIED_SQL + """
SELECT tour_id, CASE WHEN changed THEN first ELSE tour_id % n END::INTEGER AS current_index, CASE WHEN changed THEN before END AS "before", CASE WHEN changed THEN after END AS "after",
       CASE WHEN changed THEN before[tour_id % n + 1] END AS "current" FROM t JOIN after USING (tour_id)""")
def applied_plans(spark, d):
    after, _, _ = routes.apply_plans(*tours_and_orders(spark, d))
    return after.select("tour_id", "current_index", "undo.before", "undo.after", "undo.current")


@query("undone_plans", S + APPLIED_SQL + """
SELECT tour_id, CASE WHEN NOT changed OR list_contains(opens, tour_id % n) THEN tour_id % n ELSE first END::INTEGER AS current_index, before AS ids FROM t""")
def undone_plans(spark, d):
    """Plans applied and taken back: the stops stand as before, the index is at the stop that was current if it is open."""
    after, moved, _ = routes.apply_plans(*tours_and_orders(spark, d))
    tours, back = routes.undo_plans(after, moved)
    ids = back.groupBy("tour_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("ids"))
    return tours.select("tour_id", "current_index").join(ids, "tour_id")


@query("saved_states", S + APPLIED_SQL + "SELECT tour_id, changed AND tour_id % 3 <> 0 AS has_undo, tour_id % 2 = 0 AS has_map FROM t")
def saved_states(spark, d):
    """What is stored of tours after a plan: the undo record unless stops moved since (every third tour), the map if it fits the stops."""
    after, moved, _ = routes.apply_plans(*tours_and_orders(spark, d))
    swapped = moved.withColumn("pos", F.when(F.col("tour_id") % 3 == 0, -F.col("pos")).otherwise(F.col("pos")))
    keys = routes.tour_keys(swapped).select("tour_id", F.when(F.col("tour_id") % 2 == 0, F.col("tour_key")).otherwise("[]").alias("map_key"))
    kept = routes.saved(after.join(keys, "tour_id"), swapped, "2024-05-01 12:00:00")
    return kept.select("tour_id", F.col("undo").isNotNull().alias("has_undo"), F.col("map_key").isNotNull().alias("has_map"))


@query("plan_snapshots", S + "," + ANSWERS_SQL + """
SELECT tour_id AS plan_id, 1 AS version, CASE WHEN faster THEN by_rank ELSE range(n) END::INTEGER[] AS "order", n AS n_points, base::DOUBLE AS before_seconds, CASE WHEN faster THEN trip ELSE base END::DOUBLE AS after_seconds
FROM plan WHERE n >= 2 AND NOT bad""")
def plan_snapshots(spark, d):
    points = P.points(spark, d).select(F.col("tour_id").alias("plan_id"), "pos", "lat", "lon", F.col("stop_id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("a").alias("address"))
    shots = routes.snapshots(routes.select_plans(answers(spark, d)), points)
    return shots.select("plan_id", "version", "order", F.size("points").cast("long").alias("n_points"), F.col("before.duration").alias("before_seconds"), F.col("after.duration").alias("after_seconds"))


@query("drawn_lines", S + ", " + P.POINTS_SQL + "SELECT tour_id, count(*) >= 2 AND max(abs(lat)) <= 90 AS drawn FROM points GROUP BY tour_id")
def drawn_lines(spark, d):
    line = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return P.points(spark, d).groupBy("tour_id").agg(line.alias("p")).select("tour_id", geo.line_or_null(F.col("p")).isNotNull().alias("drawn"))


# --- stores and providers ---------------------------------------------------------------------------
@query("current_stops", "SELECT o_orderkey AS stop_id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def current_stops(spark, d):
    stops = P.stops(spark, d)
    meta = stops.agg(F.min("tour_id").cast("string").alias("value")).select(F.lit("currentTourId").alias("key"), "value")
    return store.current_tour(stops, meta).select("stop_id")


@query("migrated_stops", S + "SELECT tour_id AS pos, '' AS name, CASE WHEN address = '' THEN '?' ELSE address END AS address, '' AS postal FROM stops WHERE pos = 0")
def migrated_stops(spark, d):
    """The newest generation is empty, the next has bare addresses, the oldest is not looked at."""
    stops = P.stops(spark, d)
    bare = stops.where("pos = 0").select(F.col("tour_id").alias("pos"), F.when(F.col("address") == "", "?").otherwise(F.col("address")).alias("address"))
    old = stops.select("pos", "name", "address", F.coalesce("postal", F.lit("")).alias("postal"))
    return store.migrate(stops.where("false"), [old.where("false"), bare, old])


@query("labelled_candidates", S + """
SELECT stop_id, array_to_string(list_filter([CASE WHEN stop_id % 3 = 0 THEN 'Laden' ELSE '' END, trim(concat('Weg ', CASE WHEN stop_id % 2 = 0 THEN '7' ELSE '' END)), trim(concat(coalesce(substr(postal, 1, 4), ''), ' Ort')), CASE WHEN stop_id % 5 = 0 THEN '' ELSE 'AT' END], lambda x: x <> ''), ', ') AS label FROM stops""")
def labelled_candidates(spark, d):
    k = F.col("stop_id")
    label = match.label(F.when(k % 3 == 0, "Laden"), F.lit("Weg"), F.when(k % 2 == 0, "7").otherwise(""), F.substring("postal", 1, 4), F.lit("Ort"), F.when(k % 5 != 0, "AT"))
    return P.stops(spark, d).select("stop_id", label.alias("label"))


@query("limited_candidates", "SELECT l_orderkey AS request_id, l_linenumber * 1000000 + l_partkey AS cand_pos FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey) <= 5")
def limited_candidates(spark, d):
    rows = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("cand_pos"))
    return match.limit_candidates(rows)


@query("start_fixes", """
SELECT user_id AS tour_id, arg_min(event_id, epoch_us(ts) * 1000 + event_id % 1000) AS event_id FROM events WHERE event_id % 1500 <= 1000 GROUP BY user_id""")
def start_fixes(spark, d):
    """The first fix of each tour within 1000 metres; of equal times, that of least id modulo 1000."""
    e = P.table(spark, d, "events")
    order = F.struct("ts", (F.col("event_id") % 1000).alias("n"))
    fixes = e.select(F.col("user_id").alias("tour_id"), (F.col("event_id") % 1500).cast("double").alias("accuracy"), order.alias("ts"), F.col("event_id").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return store.start_points(fixes).select("tour_id", F.col("lat").cast("long").alias("event_id"))


@query("normalized_tours", """
SELECT CAST(c_custkey AS VARCHAR) AS tour_id, CASE WHEN c_custkey % 3 = 0 THEN 'Unbenannte Tour' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'import' ELSE 'manual' END AS source, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 7 END::INTEGER AS current_index FROM customer""")
def normalized_tours(spark, d):
    k = F.col("c_custkey")
    raw = P.table(spark, d, "customer").select(k.alias("tour_id"), F.when(k % 3 != 0, F.col("c_name")).otherwise("").alias("name"), F.when(k % 2 == 0, "import").alias("source"), F.when(k % 5 != 0, k % 7).cast("int").alias("current_index"))
    return records.normalize_tours(raw).select("tour_id", "name", "source", "current_index")


# --- lines ------------------------------------------------------------------------------------------
#: Texts by the part's key, with what becomes of each: junk or not, tidied, shown.
SAMPLES = (
    ("— |", True, "", "-"),
    ("x", True, "x", "x"),
    ("12/34.", True, "12/34.", "12/34."),
    ("(B)", False, "B)", "(B)"),
    ("» 7 —KNR 12345 ; l", False, "7  KNR 12345", "» 7 -KNR 12345 - l"),
    ("Cafe Linde ; - Bar:", False, "Cafe Linde ; - Bar:", "Cafe Linde - Bar"),
    ("Shop;Haus - - ", False, "Shop;Haus - -", "Shop - Haus"),
    ("Am Kai  3 | ' i", False, "Am Kai 3", "Am Kai 3 ' i"),
)


@query("sampled_lines", "SELECT p_partkey, " + ", ".join(f"CASE p_partkey % {len(SAMPLES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {name}" for name, values in (
    ("junk", [str(s[1]).lower() for s in SAMPLES]), ("tidy", ["'" + s[2].replace("'", "''") + "'" for s in SAMPLES]), ("shown", ["'" + s[3].replace("'", "''") + "'" for s in SAMPLES]))) + " FROM part")
def sampled_lines(spark, d):
    text = F.element_at(F.array(*(F.lit(s[0]) for s in SAMPLES)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    rows = P.table(spark, d, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", pages.junk(F.col("t")).alias("junk"), pages.tidy(F.col("t")).alias("tidy"), lines.display_name(F.col("t")).alias("shown"))


# --- layout -----------------------------------------------------------------------------------------
ROWS_SQL = "r AS (SELECT page_id, word_id % 4 AS band_id, word_id AS row_id, y0 AS yd, 10.0 + word_id % 5 AS h, CASE word_id % 6 WHEN 0 THEN 'Behältemappe' WHEN 1 THEN 'Lieferung' WHEN 2 THEN '(B)' ELSE 'Kollektion' END AS text FROM words)"


def rows_of_bands(spark, d):
    k = F.col("word_id")
    text = F.when(k % 6 == 0, "Behältemappe").when(k % 6 == 1, "Lieferung").when(k % 6 == 2, "(B)").otherwise("Kollektion")
    return words(spark, d).select("page_id", (k % 4).alias("band_id"), k.alias("row_id"), F.col("y0").alias("yd"), (k % 5 + 10).cast("double").alias("h"), text.alias("text"))


@query("main_rows", "WITH " + WORDS_SQL + "," + ROWS_SQL + """,
f AS (SELECT *, abs(yd - 300) AS far, max(h) OVER (PARTITION BY page_id, band_id) AS tall FROM r WHERE text <> 'Lieferung')
SELECT page_id, band_id, row_id FROM f QUALIFY row_number() OVER (PARTITION BY page_id, band_id ORDER BY text = 'Behältemappe', CASE WHEN far <= 1.5 * tall THEN far END NULLS LAST, yd, row_id) = 1""")
def main_rows(spark, d):
    rows = rows_of_bands(spark, d)
    return Y.main_rows(rows, rows.select("page_id", "band_id").distinct().withColumn("anchor_yd", F.lit(300.0))).select("page_id", "band_id", "row_id")


@query("wrapped_letters", "WITH " + WORDS_SQL + "," + ROWS_SQL + """
SELECT page_id, band_id, row_id, CASE WHEN lead(text) OVER w = '(B)' AND lead(yd) OVER w - yd < 2.5 * h THEN 'B' END AS wrapped FROM r WINDOW w AS (PARTITION BY page_id, band_id ORDER BY yd, row_id)""")
def wrapped_letters(spark, d):
    return Y.wrapped_letters(rows_of_bands(spark, d)).select("page_id", "band_id", "row_id", "wrapped")


@query("layer_words", "SELECT p_partkey AS word_id, (p_partkey % 500)::DOUBLE AS x0, (p_partkey % 500 + 2 * (p_size + 3))::DOUBLE AS x1, (100 - greatest(1, 2 * (p_size % 4)))::DOUBLE AS y0, 100.0::DOUBLE AS y1 FROM part WHERE p_partkey % 7 <> 0")
def layer_words(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    glyphs = P.table(spark, d, "part").select(F.lit(1).alias("page_id"), k.alias("word_id"), F.when(k % 7 == 0, "  ").otherwise("t").alias("text"), (k % 500).cast("double").alias("x"), F.lit(100.0).alias("y"), (size + 3).cast("double").alias("w"), (-(size % 4)).cast("double").alias("h"))
    return Y.glyphs_to_words(glyphs, F.lit(2.0)).select("word_id", "x0", "x1", "y0", "y1")


@query("local_slopes", "WITH " + WORDS_SQL + """,
b AS (SELECT page_id, y0 * 4 + (word_id % 5) / 2 AS y, (word_id % 5)::DOUBLE / 256 AS s FROM words WHERE word_id % 3 <> 0),
p AS (SELECT page_id, count(*) AS n, list_sort(list(s)) AS l FROM b GROUP BY 1),
m AS (SELECT a.page_id, a.y, a.s, list_sort(list(b.s)) AS near FROM (SELECT DISTINCT page_id, y, s FROM b) a JOIN b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 120 GROUP BY 1, 2, 3)
SELECT DISTINCT page_id, y, CASE WHEN n < 3 THEN 0 WHEN len(near) >= 3 THEN near[len(near) // 2 + 1] ELSE l[n // 2 + 1] END::DOUBLE AS slope FROM m JOIN p USING (page_id)""")
def local_slopes(spark, d):
    """Baselines of 256 points length, down by 0 to 4; every third is too short to count."""
    k = F.col("word_id")
    lines_ = words(spark, d).select("page_id", F.lit(0.0).alias("x0"), F.when(k % 3 == 0, 100.0).otherwise(256.0).alias("x1"), (F.col("y0") * 4).alias("y0"), (F.col("y0") * 4 + k % 5).alias("y1"))
    return Y.local_slopes(lines_, words(spark, d).select("page_id").distinct().withColumn("width", F.lit(1000.0))).distinct()


@query("leaning_columns", "SELECT c_custkey AS page_id, (c_custkey % 5 - 2)::DOUBLE / 32 AS drift_m, 0.0::DOUBLE AS drift_b, 512.0::DOUBLE AS drift_x0 FROM customer WHERE c_custkey % 4 <> 0")
def leaning_columns(spark, d):
    """Two columns of five marks that lean alike, and one mark far off each; every fourth page has too few marks."""
    k, i = F.col("page_id"), F.col("pos")
    marks = P.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(F.array(F.lit(256.0), F.lit(768.0))).alias("at"))
    marks = marks.select("page_id", F.col("at").cast("string").alias("family"), "at", F.explode(F.sequence(F.lit(0), F.when(k % 4 == 0, 1).otherwise(4))).alias("pos"))
    lean = (k % 5 - 2).cast("double") / 32
    anchors = marks.select("page_id", "family", "pos", (F.col("at") + lean * (i - 2) * 256).alias("x"), (i.cast("double") * 256).alias("y"))
    return Y.column_drift(anchors, anchors.select("page_id").distinct().withColumn("width", F.lit(1024.0)))


@query("found_headers", """
SELECT c_custkey AS page_id, 600.0::DOUBLE + c_custkey % 5 AS class_x, 40.0::DOUBLE AS class_y, CASE WHEN c_custkey % 2 = 0 THEN 660.0 + c_custkey % 5 END::DOUBLE AS lief_x,
       CASE WHEN c_custkey % 3 = 0 THEN 780.0 + c_custkey % 5 END::DOUBLE AS preis_x, (2 * (1 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT) + c_custkey % 4)::BIGINT AS score
FROM customer WHERE c_custkey % 7 <> 0""")
def found_headers(spark, d):
    """Pages with a misread title of the class column (every seventh has none), other titles by the page, and 0 to 3 parcels below."""
    k = F.col("page_id")
    word = lambda text, x, y, when: F.when(when, F.struct(F.lit(text).alias("text"), x.alias("x0"), F.lit(y).alias("y")))
    at = (k % 5).cast("double")
    held = F.array(
        word("Klasce", at + 600, 34.0, k % 7 != 0), word("Lief.", at + 660, 34.0, k % 2 == 0), word("Preis", at + 780, 36.0, k % 3 == 0), word("Kunde", at + 10, 34.0, F.lit(True)),
        *(word("Lieferpaket", at + 400, 100.0 + 60 * i, k % 4 > i) for i in range(3)),
    )
    page = P.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))
    rows = page.select("page_id", F.posexplode(F.filter(held, lambda w: w.isNotNull())).alias("word_id", "w"))
    rows = rows.select("page_id", "word_id", "w.text", "w.x0", (F.col("w.x0") + 40).alias("x1"), F.col("w.y").alias("y0"), (F.col("w.y") + 12).alias("y1"))
    found = Y.find_header(rows, page.withColumn("width", F.lit(1000.0)))
    return found.select("page_id", "class_x", "class_y", "lief_x", "preis_x", F.col("score").cast("long").alias("score"))


@query("reread_matches", "SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey END AS evidence_id FROM orders WHERE o_orderkey % 4 < 2")
def reread_matches(spark, d):
    """Of four stops one is found by its address, one by its height, one has two rows near it and one has none."""
    k = F.col("o_orderkey")
    orders = P.table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), k)
    y = (k * 100).cast("double")
    again = orders.select("page_id", k.alias("pos"), F.when(k % 4 == 0, F.concat(F.lit("Weg "), k.cast("string"))).otherwise("").alias("address"), y.alias("yd"), F.lit(10.0).alias("h"))
    off = F.when(k % 4 == 0, F.array(F.lit(5000.0))).when(k % 4 == 1, F.array(F.lit(12.0))).when(k % 4 == 2, F.array(F.lit(-5.0), F.lit(5.0))).otherwise(F.array(F.lit(40.0)))
    first = orders.select("page_id", k, y.alias("yd"), F.posexplode(off).alias("i", "off"))
    first = first.select("page_id", (k + F.when(F.col("i") == 1, 1_000_000_000).otherwise(0)).alias("evidence_id"), F.when(k % 4 == 0, F.concat(F.lit("Weg "), k.cast("string"))).otherwise("other").alias("address"), (F.col("yd") + F.col("off") + F.when(k % 4 == 0, 1e9).otherwise(0.0)).alias("yd"), F.lit(10.0).alias("h"))
    return Y.match_rereads(again, first).select("pos", "evidence_id")


@query("mapped_words", "WITH " + WORDS_SQL + """
SELECT page_id, word_id, x0, y0 FROM words WHERE NOT ((y0 + y1) / 2 BETWEEN 200 AND 300 AND page_id % 2 = 0)
UNION ALL SELECT page_id, -word_id, x0, y0 FROM words WHERE (y0 + y1) / 2 BETWEEN 200 AND 300 AND page_id % 2 = 0""")
def mapped_words(spark, d):
    """The words of a strip read again at twice the size, with 8 points of margin and 4 of edge, come back where they were."""
    w = words(spark, d)
    regions = w.where("page_id % 2 = 0").select("page_id").distinct().select("page_id", F.lit(1).alias("region_id"), *(F.lit(v).alias(c) for c, v in (("yd", 250.0), ("half", 50.0), ("slope", 0.0), ("x0", 0.0), ("margin", 8.0), ("pad", 4.0), ("scale", 2.0))))
    inside = w.where("page_id % 2 = 0 AND (y0 + y1) / 2 BETWEEN 200 AND 300")
    u = lambda c: (F.col(c) + 8.0) * 2 + 4
    v = lambda c: (F.col(c) - 200.0 + 8.0) * 2 + 4
    again = inside.select("page_id", F.lit(1).alias("region_id"), (-F.col("word_id")).alias("word_id"), "text", u("x0").alias("x0"), u("x1").alias("x1"), v("y0").alias("y0"), v("y1").alias("y1"), "confidence")
    blank = again.where("word_id % 5 = 0").withColumn("text", F.lit(" "))
    return Y.region_words(w, regions, again.unionByName(blank)).select("page_id", "word_id", "x0", "y0")


# --- evidence ---------------------------------------------------------------------------------------
#: What page and cells say of a stop, by its key, and what comes of it.
EVIDENCE = (
    (("Lieferpaket", None, "", 90.0, ()), (), "Lieferpaket", ""),
    (("Sommer Kollektion (B)", "38", "38/2", 90.0, ()), (), "Sommer Kollektion 38 B", ""),
    (("Sommer Kollektion (B)", "38", "38/2", 90.0, ()), (("label", 0, "Sommer Kollektion (C)", 90.0),), "Sommer Kollektion", "Buchstabe unklar (B oder C). Bitte am PDF prüfen."),
    (("Sommer Kollektion (B)", None, "", 90.0, ()), (("label", 0, "Sommer Kollektion (B)", 90.0), ("number", 0, "38/1", 90.0), ("number", 1, "39/1", 90.0)), "Sommer Kollektion", "Liefermenge unklar (38 oder 39). Bitte am PDF prüfen."),
    (("Sommer Kollektion (B)", None, "", 90.0, ()), (("label", 0, "Lieferpaket", 90.0),), "", "Lieferpaket oder Kollektion? Bitte am PDF prüfen."),
    (("Sommer Kollektion (B)", None, "", 90.0, ()), (("label", 0, "Sommer Kollektion (B)", 90.0), ("number", 0, "38/1", 90.0), ("number", 1, "38/1", 90.0)), "Sommer Kollektion 38 B", ""),
    (("Sommer Kollektion (B)", "38", "38", 90.0, ("41",)), (), "Sommer Kollektion", "Abweichende Nummern im Kundenblock. Kollektionsnummer am PDF prüfen."),
    (("Sommer Kollektion (B)", "38", "38", 40.0, ()), (), "Sommer Kollektion 38 B", "Liefermenge unsicher erkannt. Bitte am PDF prüfen."),
)


@query("refined_stops", "SELECT o_orderkey::VARCHAR AS stop_id, " + ", ".join(f"CASE o_orderkey % {len(EVIDENCE)} " + " ".join(f"WHEN {i} THEN '{e[at]}'" for i, e in enumerate(EVIDENCE)) + f" END AS {name}" for at, name in ((2, "delivery_type"), (3, "delivery_review"))) + " FROM orders")
def refined_stops(spark, d):
    n = len(EVIDENCE)
    orders = P.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("stop_id"), (F.col("o_orderkey") % n).cast("int").alias("case"))
    pages_ = spark.createDataFrame([(i, *e[0][:4], list(e[0][4])) for i, e in enumerate(EVIDENCE)], "case int, label string, number string, number_text string, confidence double, companion_numbers array<string>")
    cells = spark.createDataFrame([(i, kind, variant, 0, text, sure) for i, e in enumerate(EVIDENCE) for kind, variant, text, sure in e[1]], "case int, kind string, variant int, y_shift int, text string, confidence double")
    return rereads.refine(orders.join(F.broadcast(pages_), "case").drop("case"), orders.join(F.broadcast(cells), "case").drop("case"))


# --- pixels -----------------------------------------------------------------------------------------
def drawn(spark, d, draw):
    """An image a nation, drawn from its key."""

    def run(batches):
        for b in batches:
            for k in b["k"]:
                g = draw(int(k))
                yield pd.DataFrame({"image_id": [str(k)], "width": [g.shape[1]], "height": [g.shape[0]], "rgba": [raster.to_rgba(g)]})

    return P.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).mapInPandas(run, "image_id string, width int, height int, rgba binary")


def measured(images, f, fields):
    """``f`` of every image's brightness, a row each."""

    def run(batches):
        for b in batches:
            rows = [(r.image_id, *f(raster.grey(r.rgba, r.width, r.height))) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["image_id", *(x.split()[0] for x in fields.split(", "))])

    return images.mapInPandas(run, f"image_id string, {fields}")


def _cell(k):
    g = np.full((60, 120), 255.0)
    g[20:40, 30 : 35 + k % 7] = 0
    g[2:58, 15], g[30, 80], g[0:20, 100:110] = 0, 0, 0  # a rule, a speck, a shape that the edge cuts
    return g


@query("cleared_cells", "SELECT CAST(n_nationkey AS VARCHAR) AS image_id, 20 * (5 + n_nationkey % 7)::BIGINT AS ink FROM nation")
def cleared_cells(spark, d):
    """The ink that is left of a letter beside a rule, a speck and a shape that the edge cuts."""
    cleared = raster.map_images(drawn(spark, d, _cell), lambda g: raster.clear_rules(g, 20))
    return measured(cleared, lambda g: (int((g < 128).sum()),), "ink long")


def _column(k):
    g = np.full((200, 300), 255.0)
    for y in range(20, 180, 20):
        at = np.round(y + (k % 5 - 2) * 0.02 * (np.arange(300) - 300)).astype(int)
        for i in range(3):
            g[np.clip(at + i, 0, 199), np.arange(300)] = 0
    return g


@query("sheared_columns", "SELECT CAST(n_nationkey AS VARCHAR) AS image_id, (n_nationkey % 5 - 2)::BIGINT AS fiftieths FROM nation")
def sheared_columns(spark, d):
    """The slope of a column's lines at its middle, in fiftieths."""
    at_middle = lambda g: (int(np.floor(raster.slope_at(raster.smoothed(raster.column_shear(g, char_height=10)), np.array([100.0]))[0] * 50 + 0.5)),)
    return measured(drawn(spark, d, _column), at_middle, "fiftieths long")


def _line(k):
    g = np.full((60, 240), 255.0)
    for x in range(240):
        at = 24 + int((k % 5 - 2) * 2 * x / 240)
        g[at : at + 10, x] = 0
    return g


@query("followed_lines", "SELECT CAST(n_nationkey AS VARCHAR) AS image_id, true AS straight, 2400::BIGINT AS ink FROM nation")
def followed_lines(spark, d):
    """Whether a bent line runs within two points of straight once it was followed, and that no ink is lost."""

    def look(g):
        middle = [np.flatnonzero(g[:, x] < 128).mean() for x in range(g.shape[1])]
        return max(middle) - min(middle) <= 2, int((g < 128).sum())

    return measured(raster.map_images(drawn(spark, d, _line), lambda g: raster.follow_line(g, 12)), look, "straight boolean, ink long")


# --- whole pages ------------------------------------------------------------------------------------
@query("page_stops", """
SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, concat('Firma Nummer', CAST(o_orderkey AS VARCHAR)) AS name, concat('Lindenweg ', CAST(o_orderkey % 90 + 1 AS VARCHAR)) AS address,
       concat(CAST(2000 + o_orderkey % 7000 AS VARCHAR), ' Hollabrunn') AS postal, CASE WHEN o_orderkey % 3 = 0 THEN 'Lieferpaket' ELSE 'Sommer Kollektion 38 B' END AS delivery_type, '' AS delivery_review, false AS needs_review FROM orders""")
def page_stops(spark, d):
    """A page a customer, ninety points a stop: its lines on the left, then what it gets, for every third
    with the letter on the next row, and the number of a collection."""
    k, n, text = F.col("o_orderkey"), F.col("n"), lambda c: c.cast("string")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = P.table(spark, d, "orders").withColumn("n", F.row_number().over(order) - 1)
    word = lambda t, x, dy: F.struct((t if not isinstance(t, str) else F.lit(t)).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(dy)).alias("dy"))
    lines_ = [word(text(n + 1), 10, 0), word("KNR:", 40, 0), word(text(k + 10_000), 90, 0), word("Firma", 10, 20), word(F.concat(F.lit("Nummer"), text(k)), 60, 20), word("Lindenweg", 10, 40), word(text(k % 90 + 1), 110, 40), word(text(k % 7000 + 2000), 10, 60), word("Hollabrunn", 60, 60)]
    kind = k % 3
    parcel, title, letter, number = [word("Lieferpaket", 330, 0)], [word("Sommer", 330, 0), word("Kollektion", 400, 0)], [word("(B)", 490, 0)], [word("38/2", 610, 0)]
    got = F.when(kind == 0, F.array(*parcel)).when(kind == 1, F.array(*title, *letter, *number)).otherwise(F.array(*title, word("(B)", 330, 20), *number))
    words_ = orders.select(F.col("o_custkey").alias("page_id"), "n", F.posexplode(F.concat(F.array(*lines_), got)).alias("i", "w"))
    y = F.col("n") * 90 + 100 + F.col("w.dy")
    words_ = words_.select("page_id", (F.col("n") * 100 + F.col("i")).cast("long").alias("word_id"), "w.text", "w.x0", (F.col("w.x0") + 30).alias("x1"), y.alias("y0"), (y + 12).alias("y1"), F.lit(95.0).alias("confidence"))
    found = pages.read_pages(words_, words_.select("page_id").distinct().withColumn("width", F.lit(1000.0)))
    return found.select("page_id", "pos", "name", "address", "postal", "delivery_type", "delivery_review", "needs_review")
