"""Queries about imported texts, delivery labels and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import proxies as P
from ..functions import delivery, lines, text as X
from ..operators import importer, match, votes
from ..streaming import tours as live

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- lists: a customer's orders as the text of a printed list, with the odd mark and noise ----------
LISTS_SQL = """
list_lines AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
texts AS (
  SELECT doc_id, 'Tourenliste  |  Seite 1' || chr(10) || string_agg(
    CASE WHEN k % 4 = 3 THEN '' ELSE concat(CAST(n % 99 + 1 AS VARCHAR), ' KNR: ', CAST(10000 + k AS VARCHAR), chr(10)) END
    || concat('Firma Nummer', CAST(k AS VARCHAR), ' –  Haus', chr(10)) || CASE WHEN k % 9 = 4 THEN concat('Tel: 0123', chr(10)) ELSE '' END
    || concat(CASE k % 5 WHEN 0 THEN 'Sparkassegasse ' WHEN 1 THEN 'Horner Stra@e ' WHEN 2 THEN 'Gratzl ' WHEN 3 THEN 'Am Stadtplatz ' ELSE 'Lindenweg ' END, CAST(k % 90 + 1 AS VARCHAR),
              CASE WHEN k % 6 = 1 THEN ' / 3' ELSE '' END, CASE WHEN k % 8 = 5 THEN ' ' ELSE chr(10) END)
    || concat('A-', CAST(2000 + k % 7000 AS VARCHAR), ' Hollabrunn', CASE WHEN k % 7 = 2 THEN ' P' ELSE '' END), chr(10) ORDER BY n) AS text
  FROM list_lines GROUP BY doc_id)
"""


def lists(spark, d):
    """The same texts as a table of ``(doc_id, text)``."""
    from pyspark.sql import Window

    orders = P.table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    street = F.element_at(F.array(*map(F.lit, ("Sparkassegasse ", "Horner Stra@e ", "Gratzl ", "Am Stadtplatz ", "Lindenweg "))), (k % 5 + 1).cast("int"))
    stop = F.concat(
        F.when(k % 4 == 3, "").otherwise(F.concat(s(F.col("n") % 99 + 1), F.lit(" KNR: "), s(k + 10_000), F.lit("\n"))), F.lit("Firma Nummer"), s(k), F.lit(" –  Haus\n"), F.when(k % 9 == 4, "Tel: 0123\n").otherwise(""),
        street, s(k % 90 + 1), F.when(k % 6 == 1, " / 3").otherwise(""), F.when(k % 8 == 5, " ").otherwise("\n"), F.lit("A-"), s(k % 7000 + 2000), F.lit(" Hollabrunn"), F.when(k % 7 == 2, " P").otherwise(""),
    )
    rows = orders.withColumn("n", n).select(F.col("o_custkey").alias("doc_id"), "n", stop.alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("x"))
    return rows.select("doc_id", F.concat(F.lit("Tourenliste  |  Seite 1\n"), F.array_join(F.transform("x", lambda x: x["s"]), "\n")).alias("text"))


CLEAN = "trim(regexp_replace(translate(regexp_replace({0}, '\\|+', ' ', 'g'), '–—', '--'), '\\s+', ' ', 'g'))"
JOINED = r"'(?i)^(.*?\d+[a-zA-Z]?)\s+(A[-\s]?\d{4}\s+.+)$'"
LINES_SQL = LISTS_SQL + f""",
raw AS (SELECT doc_id, i, {CLEAN.format('l[i]')} AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts), unnest(range(1, len(l) + 1)) AS u(i)),
parts AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, {JOINED}) AND NOT regexp_matches(t, '(?i)tel[:.]?') THEN [regexp_extract(t, {JOINED}, 1), regexp_extract(t, {JOINED}, 2)] ELSE [t] END AS p FROM raw WHERE t <> ''),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS line_no, p[j] AS line FROM parts, unnest(range(1, len(p) + 1)) AS u(j))
"""
W = "WITH " + LINES_SQL
POSTAL = r"'(?i)^(?:A[-\s]?|4-)?(\d{4})\s+(.+)$'"
CITY = rf"trim(regexp_replace(regexp_replace(regexp_extract(line, {POSTAL}, 2), '[;,.:]+$', ''), '(?:\s+[A-Za-z|!:;''])+$', ''))"
HEAD = r"regexp_matches(line, '(?i)^\d{1,3}\s+(?:k\s*n\s*r|knr)[.:]?\s*\d{4,}')"
NOISY = r"(regexp_matches(lower(line), 'tourenliste|seite \d|^tel[:.]?') OR regexp_matches(line, '^[\d\s.,/*()_-]+$'))"


@query("list_lines", W + "SELECT doc_id, line_no, line FROM lines")
def list_lines(spark, d):
    return importer.numbered_lines(lists(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


@query("postal_lines", W + rf"SELECT doc_id, line_no, regexp_extract(line, {POSTAL}, 1) AS postal, {CITY} AS city FROM lines WHERE regexp_matches(line, {POSTAL}) AND {CITY} <> '' AND NOT regexp_matches({CITY}, '(?i)tel[:.]?|telefon')")
def postal_lines(spark, d):
    rows = importer.numbered_lines(lists(spark, d)).withColumn("p", lines.postal_line(F.col("line"))).where("p IS NOT NULL")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "p.postal", "p.city")


@query("line_kinds", W + f"SELECT doc_id, line_no, {HEAD} AS header, {NOISY} AS noise, CASE WHEN regexp_matches(line, '^\\d{{1,3}}\\b') THEN CAST(regexp_extract(line, '^\\d{{1,3}}') AS INTEGER) END AS stop_number FROM lines")
def line_kinds(spark, d):
    line = F.col("line")
    return importer.numbered_lines(lists(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), lines.is_header(line).alias("header"), lines.is_noise(line).alias("noise"), lines.stop_number(line).alias("stop_number"))


@query("list_blocks", W + f""", k AS (SELECT *, {HEAD} AS head, {NOISY} AS noise FROM lines),
s AS (SELECT *, sum(CASE WHEN head OR NOT noise THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM k),
f AS (SELECT *, CASE WHEN head OR (seen = 1 AND lag(seen, 1, 0) OVER (PARTITION BY doc_id ORDER BY line_no) = 0) THEN 1 ELSE 0 END AS start FROM s WHERE seen > 0)
SELECT doc_id, line_no, (sum(start) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS block FROM f""")
def list_blocks(spark, d):
    return importer.blocks(importer.numbered_lines(lists(spark, d))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "block")


@query("look_back", W + rf""", p AS (SELECT *, regexp_matches(line, {POSTAL}) AND {CITY} <> '' AS is_postal FROM lines),
q AS (SELECT *, coalesce(last_value(CASE WHEN is_postal THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM p)
SELECT doc_id, line_no, greatest(last + 1, line_no - 8) AS from_line, line_no - greatest(last + 1, line_no - 8) AS n_before FROM q WHERE is_postal""")
def look_back(spark, d):
    rows = importer.look_back(importer.numbered_lines(lists(spark, d)))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("from_line").cast("long").alias("from_line"), F.size("before").cast("long").alias("n_before"))


@query("imported_stops", "WITH " + LISTS_SQL + """
SELECT doc_id, count(*) AS n_stops, string_agg(concat(CASE k % 5 WHEN 0 THEN 'Sparkassegasse ' WHEN 1 THEN 'Horner Straße ' WHEN 2 THEN 'Gratzl ' WHEN 3 THEN 'Am Stadtplatz ' ELSE 'Lindenweg ' END,
  CAST(k % 90 + 1 AS VARCHAR), CASE WHEN k % 6 = 1 AND k % 5 = 1 THEN ' / 3' WHEN k % 6 = 1 THEN '/3' ELSE '' END), ';' ORDER BY n) AS addresses,
  string_agg(concat(CAST(2000 + k % 7000 AS VARCHAR), ' Hollabrunn'), ';' ORDER BY n) AS postals,
  string_agg(concat('Firma Nummer', CAST(k AS VARCHAR), ' - Haus'), ';' ORDER BY n) AS names, count(*) FILTER (false) AS n_reviews FROM list_lines GROUP BY doc_id""")
def imported_stops(spark, d):
    """All stops of the lists; their parts come back whatever noise stood between.  Door numbers are
    drawn together, except where the street's word stands alone and the line is taken as it is."""
    # made by a small shuffle, the lists stand in few partitions; reading them takes all cores
    texts = lists(spark, d).repartition(spark.sparkContext.defaultParallelism)
    found = importer.parse_stops(texts).groupBy("doc_id").agg(F.count("*").alias("n_stops"), F.sort_array(F.collect_list(F.struct("pos", "address", "postal", "name"))).alias("s"), F.count_if("needs_review").alias("n_reviews"))
    part = lambda k: F.array_join(F.transform("s", lambda s: s[k]), ";")
    return found.select("doc_id", "n_stops", part("address").alias("addresses"), part("postal").alias("postals"), part("name").alias("names"), "n_reviews")


@query("structured_lists", """
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line_no, concat('Laden ', CAST(o_orderkey AS VARCHAR)) AS name, 'Am Kai 3' AS address, concat(CAST(1000 + o_orderkey % 9000 AS VARCHAR), ' Ort') AS postal
FROM orders WHERE o_orderkey % 2 = 0 QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2""")
def structured_lists(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("Laden "), k.cast("string"), F.lit(" ; Am  Kai 3;"), (k % 9000 + 1000).cast("string"), F.lit(" Ort"))
    texts = P.table(spark, d, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return importer.structured(importer.numbered_lines(texts)).withColumn("line_no", F.col("line_no").cast("long"))


@query("inferred_places", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'thin') THEN '1010' WHEN regexp_matches(lower(text), 'ion[a-z]') THEN '2020' END AS postal FROM documents WHERE regexp_matches(lower(text), 'thin|ion[a-z]')""")
def inferred_places(spark, d):
    places = spark.sql("SELECT * FROM VALUES ('thin', '1010', 'A', 1), ('ion[a-z]', '2020', 'B', 2) AS t(pattern, postal, city, priority)")
    return match.infer_postal(P.table(spark, d, "documents").select("doc_id", "text"), places).select("doc_id", "postal")


# --- labels ---------------------------------------------------------------------------------------------
#: Labels as scans give them, by a number; and what the numbers beside them say.
LABELS = ("Kollektion 38 (B)", "KolleKtion (C)", "Lieferpaket", "Wunsch-Kollektion WS", "Kollektion 38 B", "Kollektlon {0 (D)", "DS", "Classic Kollektion (P)", "")
NUMBERS = ("38/ 37*", "35/ -", ":38/ 37\"", "1 37/36", "38", "35 -", "371 36°", "38/37 40/39", "")


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _sql_pick(values, c):
    return "CASE " + f"{c} % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


@query("delivered_numbers", f"""
SELECT l_orderkey, l_linenumber, count(*) AS n, {_sql_pick(('38', '35', '38', '37', '38', '35', '', '', ''), '(l_orderkey + l_linenumber)')} AS number FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def delivered_numbers(spark, d):
    rows = P.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", "n", F.coalesce(delivery.delivered_number(_pick(NUMBERS, F.col("l_orderkey") + F.col("l_linenumber"))), F.lit("")).alias("number"))


@query("delivery_readings", f"""
SELECT p_partkey, {_sql_pick(('Kollektion 38 B', 'Kollektion 7 C', 'Lieferpaket', 'Wunschkollektion', 'Kollektion', 'Kollektion', 'DS', 'Classic Kollektion 7 P', ''), 'p_partkey')} AS delivery_type,
       p_partkey % 9 IN (4, 5, 8) AS review FROM part""")
def delivery_readings(spark, d):
    """Numbers beside the labels that have none of their own."""
    k = F.col("p_partkey")
    numbers = F.when((k % 9).isin(1, 7), F.array(F.lit("7"))).when(k % 9 == 5, F.array(F.lit("7"), F.lit("8"))).otherwise(F.array().cast("array<string>"))
    rows = P.table(spark, d, "part").select("p_partkey", delivery.read_delivery(_pick(LABELS, k), numbers).alias("r"))
    return rows.select("p_partkey", "r.delivery_type", (F.col("r.delivery_review") != "").alias("review"))


@query("review_notes", f"""
SELECT p_partkey, {_sql_pick(('', delivery.UNFINISHED, '', '', delivery.MISSING, '', delivery.UNFINISHED), 'p_partkey')} AS review FROM part""")
def review_notes(spark, d):
    types = ("Kollektion 38 B", "Kollektion", "Lieferpaket", "wunschkollektion", "  ", "Classic Kollektion 4 P", "Kollektion 38 (B)")
    return P.table(spark, d, "part").select("p_partkey", delivery.review_value(_pick(types, F.col("p_partkey"))).alias("review"))


@query("bracket_letters", f"""
SELECT p_partkey, {_sql_pick(('B', 'A', 'B,C', '', '', 'D', 'P', 'P', ''), 'p_partkey')} AS letters FROM part""")
def bracket_letters(spark, d):
    texts = ("38 (B)", "2A) COL", "(b) [C] (B)", "38 B", "Kollektion", "( d }", "x (P COL", "{P}", "")
    return P.table(spark, d, "part").select("p_partkey", F.array_join(delivery.collection_letters(_pick(texts, F.col("p_partkey"))), ",").alias("letters"))


CORE = "regexp_replace(translate(lower({0}), 'äöü', 'aou'), '[^a-z]', '', 'g')"


@query("canonical_words", f"""
WITH w AS (SELECT p_partkey, replace(CASE p_partkey % 4 WHEN 0 THEN 'Ko11ektion' WHEN 1 THEN 'Lieferpakct' WHEN 2 THEN 'Behältemappe' ELSE p_name END, '1', 'l') AS word FROM part), k AS (SELECT *, {CORE.format('word')} AS core FROM w)
SELECT p_partkey, CASE WHEN length(core) < 6 THEN word WHEN levenshtein(core, 'kollektion') <= 2 THEN 'Kollektion' WHEN levenshtein(core, 'wunschkollektion') <= 3 THEN 'Wunsch-Kollektion'
  WHEN levenshtein(core, 'lieferpaket') <= 2 THEN 'Lieferpaket' WHEN levenshtein(core, 'punktemappe') <= 2 THEN 'Punktemappe' WHEN levenshtein(core, 'behaltemappe') <= 2 THEN 'Behältemappe' ELSE word END AS word,
  length(core) >= 5 AND least(levenshtein(core, 'lieferung'), levenshtein(core, 'lieferart')) <= 2 AS heading FROM k""")
def canonical_words(spark, d):
    k = F.col("p_partkey") % 4
    word = F.replace(F.when(k == 0, "Ko11ektion").when(k == 1, "Lieferpakct").when(k == 2, "Behältemappe").otherwise(F.col("p_name")), F.lit("1"), F.lit("l"))
    return P.table(spark, d, "part").select("p_partkey", word.alias("w")).select("p_partkey", delivery.canonical_word(F.col("w")).alias("word"), delivery.is_heading(F.col("w")).alias("heading"))


@query("escaped_texts", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS escaped FROM documents""")
def escaped_texts(spark, d):
    return P.table(spark, d, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("escaped"))


# --- votes: the lines of an order as reads of one cell ------------------------------------------------------
VOTES_SQL = """
votes AS (SELECT l_orderkey AS stop_id, l_linenumber % 3 AS value, min(l_linenumber) AS first, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1, 2)
"""


def read_votes(spark, d):
    return P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stop_id"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") % 3).cast("string").alias("value"), F.col("l_quantity").alias("confidence"))


@query("counted_votes", "WITH " + VOTES_SQL + """
SELECT stop_id, sum(n)::BIGINT AS n_votes, count(*) AS n_values, CASE WHEN count(*) = 1 THEN CAST(any_value(value) AS VARCHAR) END AS choice, count(*) = 1 AND sum(n) = 1 AND min(low) < 55 AS uncertain,
       least(100, min(low))::DOUBLE AS min_confidence, list(CAST(value AS VARCHAR) ORDER BY n DESC, first) AS ranking FROM votes GROUP BY stop_id""")
def counted_votes(spark, d):
    return votes.count_votes(read_votes(spark, d))


@query("checked_companions", """
WITH s AS (SELECT DISTINCT l_orderkey AS stop_id, l_orderkey % 3 AS number, l_orderkey % 2 = 0 AS has_pair FROM lineitem),
c AS (SELECT s.stop_id, arg_min(l_suppkey % 3, l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000) AS companion FROM s JOIN lineitem ON l_orderkey = stop_id WHERE l_suppkey % 3 <> number GROUP BY 1)
SELECT stop_id, CASE WHEN companion IS NULL OR has_pair THEN CAST(number AS VARCHAR) END AS number, CAST(companion AS VARCHAR) AS companion,
       CASE WHEN companion IS NULL THEN 'ok' WHEN has_pair THEN 'warn' ELSE 'blocked' END AS verdict FROM s LEFT JOIN c USING (stop_id)""")
def checked_companions(spark, d):
    rows = P.table(spark, d, "lineitem")
    stops = rows.select(F.col("l_orderkey").alias("stop_id")).distinct().select("stop_id", (F.col("stop_id") % 3).cast("string").alias("number"), (F.col("stop_id") % 2 == 0).alias("has_pair"))
    pos = F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 1000 + F.col("l_partkey") % 1000
    return votes.check_companions(stops, rows.select(F.col("l_orderkey").alias("stop_id"), pos.alias("pos"), (F.col("l_suppkey") % 3).cast("string").alias("number")))


# --- events ---------------------------------------------------------------------------------------------------
@query("replayed_tours", "WITH RECURSIVE " + P.STOPS_SQL + """,
s AS (SELECT tour_id, list(stop_id ORDER BY pos) AS ids, list(status ORDER BY pos) AS st FROM stops GROUP BY tour_id),
e AS (SELECT user_id AS tour_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'not_delivered' ELSE 'later' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
      FROM events WHERE event_type IN ('purchase', 'error', 'view')),
f AS (
  SELECT tour_id, 0::BIGINT AS i, ids, st, 0::BIGINT AS cur, 0::BIGINT AS navigations FROM s
  UNION ALL
  SELECT tour_id, i, ids, st, CASE WHEN later THEN least(cur, len(ids) - 1) ELSE coalesce(target, cur) END, navigations + CASE WHEN target IS NULL THEN 0 ELSE 1 END FROM (
    SELECT *, CASE WHEN NOT later THEN coalesce(list_min(list_filter(open, lambda j: j > cur)), list_min(open)) END AS target FROM (
      SELECT *, list_filter(range(len(st)), lambda j: st[j + 1] IN ('pending', 'later')) AS open FROM (
        SELECT f.tour_id, e.i, f.cur, f.navigations, e.action = 'later' AS later,
               CASE WHEN e.action = 'later' THEN f.ids[1:f.cur] || f.ids[f.cur + 2:] || [f.ids[f.cur + 1]] ELSE f.ids END AS ids,
               CASE WHEN e.action = 'later' THEN f.st[1:f.cur] || f.st[f.cur + 2:] || ['later'] ELSE f.st[1:f.cur] || [e.action] || f.st[f.cur + 2:] END AS st
        FROM f JOIN e ON e.tour_id = f.tour_id AND e.i = f.i + 1)))),
z AS (SELECT tour_id, max(i) AS i FROM f GROUP BY tour_id)
SELECT tour_id, ids AS stop_ids, st AS statuses, cur::INTEGER AS current_index, i AS n_events, navigations AS n_navigations FROM f JOIN z USING (tour_id, i)""")
def replayed_tours(spark, d):
    """The state of every tour after its web events, folded one event at a time."""
    return live.replay(P.stops(spark, d), live.to_events(P.table(spark, d, "events")))


@query("event_counts", """
SELECT user_id AS tour_id, last(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'not_delivered' ELSE 'later' END ORDER BY ts, event_id) AS last_action, count(*) AS n_events
FROM events WHERE event_type IN ('purchase', 'error', 'view') GROUP BY user_id""")
def event_counts(spark, d):
    return live.last_status(live.to_events(P.table(spark, d, "events")))


@query("event_windows", """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'not_delivered' WHEN 'view' THEN 'later' ELSE event_type END AS action, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return live.windowed_counts(live.to_events(P.table(spark, d, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("later_order", "WITH " + P.STOPS_SQL + "SELECT tour_id, stop_id, row_number() OVER (PARTITION BY tour_id ORDER BY status = 'later', pos) - 1 AS pos FROM stops")
def later_order(spark, d):
    return live.later_order(P.stops(spark, d)).select("tour_id", "stop_id", "pos")
