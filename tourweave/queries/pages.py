"""Queries about page layout: words come from the texts, a word a token, a row a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import proxies as P
from ..functions.text import upper_median
from ..operators import cells as C, layout as Y

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Orders as words: a customer is a page of 1000 points, an order a word; a handful stands on each line.
WORDS_SQL = """
words AS (
  SELECT o_custkey AS page_id, o_orderkey AS word_id, concat('w', CAST(o_orderkey AS VARCHAR)) AS text,
         CAST((o_orderkey * 37) % 950 AS DOUBLE) AS x0, CAST((o_orderkey * 37) % 950 + 40 AS DOUBLE) AS x1,
         CAST((o_orderkey * 13) % 40 * 18 AS DOUBLE) AS y0, CAST((o_orderkey * 13) % 40 * 18 + 12 AS DOUBLE) AS y1, CAST(o_orderkey % 100 AS DOUBLE) AS confidence
  FROM orders)
"""


def words(spark, d):
    k = F.col("o_orderkey")
    x, y = (k * 37) % 950, (k * 13) % 40 * 18
    return P.table(spark, d, "orders").select(
        F.col("o_custkey").alias("page_id"), k.alias("word_id"), F.concat(F.lit("w"), k.cast("string")).alias("text"), x.cast("double").alias("x0"), (x + 40).cast("double").alias("x1"),
        y.cast("double").alias("y0"), (y + 12).cast("double").alias("y1"), (k % 100).cast("double").alias("confidence"),
    )


def flat(spark, d):
    w = words(spark, d)
    return Y.prepare(w, w.select("page_id").distinct().withColumn("slope", F.lit(0.0)))


@query("prepared_words", "WITH " + WORDS_SQL + "SELECT page_id, word_id, (y0 + y1) / 2 AS yd, x0 AS xd, greatest(1, y1 - y0) AS h FROM words")
def prepared_words(spark, d):
    return flat(spark, d).select("page_id", "word_id", "yd", "xd", "h")


COLUMN = "CASE WHEN x0 < 318 THEN 'customer' WHEN x0 < 545 THEN 'delivery' WHEN x0 < 600 THEN 'class' WHEN x0 < 675 THEN 'number' ELSE 'rest' END"


@query("word_columns", "WITH " + WORDS_SQL + f"SELECT page_id, word_id, {COLUMN} AS \"column\" FROM words")
def word_columns(spark, d):
    w = flat(spark, d)
    pages = w.select("page_id").distinct().withColumn("width", F.lit(1000.0))
    return Y.assign_columns(w, Y.columns(pages.select("page_id"), pages)).select("page_id", "word_id", "column")


BANDS_SQL = WORDS_SQL + """,
bands AS (SELECT page_id, b AS band_id, b * 100.0 + page_id % 30 AS "from", b * 100.0 + page_id % 30 + CASE WHEN b % 3 = 2 THEN 60 ELSE 100 END AS "to" FROM (SELECT DISTINCT page_id FROM words), unnest(range(7)) AS t(b))
"""


def bands(w):
    b, shift = F.col("band_id"), F.col("page_id") % 30
    pages = w.select("page_id").distinct().withColumn("band_id", F.explode(F.sequence(F.lit(0), F.lit(6))))
    low = (b * 100 + shift).cast("double")
    return pages.select("page_id", b.cast("long").alias("band_id"), low.alias("from"), (low + F.when(b % 3 == 2, 60.0).otherwise(100.0)).alias("to"))


BANDED = "WITH " + BANDS_SQL + 'SELECT w.page_id, word_id, band_id FROM words w JOIN bands b ON w.page_id = b.page_id AND (y0 + y1) / 2 >= "from" AND (y0 + y1) / 2 < "to"'


@query("word_bands", BANDED)
def word_bands(spark, d):
    w = flat(spark, d)
    return Y.assign_bands(w, bands(w)).select("page_id", "word_id", "band_id")


@query("word_bands_sorted", BANDED)
def word_bands_sorted(spark, d):
    w = flat(spark, d)
    return Y.assign_bands_sorted(w, bands(w)).select("page_id", "word_id", "band_id")


@query("visual_rows", "WITH " + WORDS_SQL + """
SELECT page_id, y0 + 6 AS yd, string_agg(text, ' ' ORDER BY x0, word_id) AS text, count(*) AS n_words, least(100, min(confidence))::DOUBLE AS min_confidence FROM words GROUP BY page_id, y0""")
def visual_rows(spark, d):
    rows = Y.visual_rows(Y.group_rows(flat(spark, d)))
    return rows.select("page_id", "yd", "text", F.size(F.split("text", " ")).cast("long").alias("n_words"), "min_confidence")


@query("page_bands", "WITH " + WORDS_SQL + """, r AS (SELECT page_id, y0 AS yd, bool_or(word_id % 5 = 0) AS anchor, bool_or(word_id % 3 = 0) AS postal FROM words GROUP BY 1, 2),
f AS (SELECT *, sum(anchor::INT) OVER w AS a, coalesce(lag(postal::INT) OVER w, 0) AS cut FROM r WINDOW w AS (PARTITION BY page_id ORDER BY yd)),
g AS (SELECT *, sum(CASE WHEN anchor THEN 1 WHEN a = 0 THEN cut ELSE 0 END) OVER (PARTITION BY page_id ORDER BY yd) AS band_id FROM f)
SELECT page_id, band_id::BIGINT AS band_id, min(yd) AS "from", bool_or(postal) AS has_postal FROM g GROUP BY page_id, band_id""")
def page_bands(spark, d):
    rows = words(spark, d).groupBy("page_id", F.col("y0").alias("yd")).agg(F.bool_or(F.col("word_id") % 5 == 0).alias("anchor"), F.bool_or(F.col("word_id") % 3 == 0).alias("postal"))
    return Y.bands_from_rows(rows).select("page_id", "band_id", "from", "has_postal")


@query("unread_regions", "WITH " + WORDS_SQL + """, r AS (SELECT page_id, y0 AS yd, CASE WHEN y0 % 36 = 0 THEN 10.0 ELSE 15.0 END::DOUBLE AS h FROM words GROUP BY ALL),
m AS (SELECT page_id, list_sort(list(h))[count(*) // 2 + 1] AS m, min(yd) AS top, arg_min(h, yd) AS top_h FROM r GROUP BY 1),
p AS (SELECT page_id, lag(yd) OVER w AS y, lag(h) OVER w AS yh, yd, h FROM r WINDOW w AS (PARTITION BY page_id ORDER BY yd)),
g AS (SELECT page_id, y + 0.8::DOUBLE * yh AS a, yd - 0.8::DOUBLE * h AS b FROM p JOIN m USING (page_id) WHERE yd - y > 4 * m
  UNION ALL SELECT page_id, -30.0, top - 0.8::DOUBLE * top_h FROM m WHERE top + 30 > 4 * m
  UNION ALL SELECT page_id, x, x + 90.0 FROM m, (VALUES (100.0::DOUBLE), (400.0)) AS v(x) WHERE page_id % 3 = 0 AND 90 > 4.5::DOUBLE * m),
k AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM k) SELECT page_id, min(a)::DOUBLE AS "from", max(b)::DOUBLE AS "to" FROM i GROUP BY page_id, island""")
def unread_regions(spark, d):
    """Rows of two heights; the header 30 above the page; every third page has two bands without a stop and one with."""
    rows = words(spark, d).select("page_id", F.col("y0").alias("yd"), F.when(F.col("y0") % 36 == 0, 10.0).otherwise(15.0).alias("h")).distinct()
    pages = rows.select("page_id").distinct()
    band = lambda a, n: pages.where("page_id % 3 = 0").select("page_id", F.lit(a).alias("from"), F.lit(a + 90).alias("to"), F.lit(n).alias("n_stops"))
    return Y.unread_regions(rows, band(100.0, 0).union(band(400.0, 0)).union(band(250.0, 1)), pages.select("page_id", F.lit(-30.0).alias("header_y")))


@query("region_words", "WITH " + WORDS_SQL + """SELECT page_id, word_id FROM words WHERE NOT ((y0 + y1) / 2 BETWEEN 200 AND 300 AND page_id % 2 = 0) UNION ALL SELECT page_id, -word_id FROM words WHERE (y0 + y1) / 2 BETWEEN 200 AND 300 AND page_id % 2 = 0""")
def region_words(spark, d):
    w = flat(spark, d).select("page_id", "word_id", "yd")
    regions = w.where("page_id % 2 = 0").select("page_id").distinct().select("page_id", F.lit(200.0).alias("from"), F.lit(300.0).alias("to"))
    again = w.where("page_id % 2 = 0 AND yd BETWEEN 200 AND 300").withColumn("word_id", -F.col("word_id"))
    return Y.replace_region_words(w, regions, again).select("page_id", "word_id")


@query("column_words", "WITH " + WORDS_SQL + f""", c AS (SELECT page_id, word_id, {COLUMN} AS col FROM words)
SELECT page_id, word_id FROM c WHERE col <> 'customer' OR page_id % 2 = 1 UNION ALL SELECT page_id, -word_id FROM c WHERE col = 'customer' AND page_id % 2 = 0""")
def column_words(spark, d):
    w = word_columns(spark, d)
    return Y.replace_column_words(w, w.where("page_id % 2 = 0").withColumn("word_id", -F.col("word_id"))).select("page_id", "word_id")


@query("upper_medians", "SELECT o_custkey, list_sort(list(o_orderkey))[count(*) // 2 + 1] AS median FROM orders GROUP BY o_custkey")
def upper_medians(spark, d):
    return P.table(spark, d, "orders").groupBy("o_custkey").agg(upper_median(F.collect_list("o_orderkey")).alias("median"))


@query("header_slopes", "WITH " + WORDS_SQL + """, p AS (SELECT page_id, word_id, x0 AS x, y0 / 64 AS y FROM words WHERE word_id % 2 = 0),
s AS (SELECT a.page_id, list_sort(list((b.y - a.y) / (b.x - a.x))) AS l FROM p a JOIN p b ON a.page_id = b.page_id AND a.word_id < b.word_id AND abs(b.x - a.x) > 150 GROUP BY 1),
n AS (SELECT page_id, count(*) AS n, max(x) - min(x) AS span FROM p GROUP BY 1)
SELECT pages.page_id, CASE WHEN n >= 3 AND span >= 350 THEN floor(coalesce(l[len(l) // 2 + 1], 0) * 1000000 + 0.5) ELSE 0 END::BIGINT AS slope FROM (SELECT DISTINCT page_id FROM words) pages LEFT JOIN s USING (page_id) LEFT JOIN n USING (page_id)""")
def header_slopes(spark, d):
    w = words(spark, d)
    points = w.where("word_id % 2 = 0").select("page_id", F.col("word_id").alias("pos"), F.col("x0").alias("x"), (F.col("y0") / 64).alias("y"))
    slopes = Y.header_slopes(points, w.select("page_id").distinct().withColumn("width", F.lit(1000.0)))
    return slopes.select("page_id", F.floor(F.col("slope") * 1_000_000 + 0.5).alias("slope"))


@query("smoothed_slopes", "WITH " + WORDS_SQL + """, k AS (SELECT page_id, y0 AS y, max(CASE WHEN word_id % 3 <> 0 THEN x0 / 64 END) AS s FROM words GROUP BY 1, 2),
n AS (SELECT a.page_id, a.y, b.s, row_number() OVER (PARTITION BY a.page_id, a.y ORDER BY abs(a.y - b.y), b.y) AS i FROM k a JOIN k b ON a.page_id = b.page_id AND b.s IS NOT NULL),
f AS (SELECT k.page_id, k.y, coalesce(n.s, 0) AS s FROM k LEFT JOIN n ON n.page_id = k.page_id AND n.y = k.y AND i = 1),
t AS (SELECT page_id, y, list_sort(list_filter([lag(s) OVER w, s, lead(s) OVER w], lambda v: v IS NOT NULL)) AS l FROM f WINDOW w AS (PARTITION BY page_id ORDER BY y))
SELECT page_id, y, l[len(l) // 2 + 1] AS slope FROM t""")
def smoothed_slopes(spark, d):
    knots = words(spark, d).groupBy("page_id", F.col("y0").alias("y")).agg(F.max(F.when(F.col("word_id") % 3 != 0, F.col("x0") / 64)).alias("slope"))
    return Y.smooth(knots).select("page_id", "y", "slope")


@query("interpolated_slopes", "WITH " + WORDS_SQL + """, k AS (SELECT page_id, y0 AS y, max(x0) / 64 AS s FROM words GROUP BY 1, 2), q AS (SELECT DISTINCT page_id, 333.0::DOUBLE AS y FROM words),
e AS (SELECT q.page_id, arg_max(k.s, k.y) FILTER (k.y <= q.y) AS s0, max(k.y) FILTER (k.y <= q.y) AS y0, arg_min(k.s, k.y) FILTER (k.y > q.y) AS s1, min(k.y) FILTER (k.y > q.y) AS y1 FROM q JOIN k USING (page_id) GROUP BY q.page_id)
SELECT page_id, floor(coalesce(s0 + (s1 - s0) * (333 - y0) / (y1 - y0), s0, s1) * 1000000 + 0.5)::BIGINT AS slope FROM e""")
def interpolated_slopes(spark, d):
    knots = words(spark, d).groupBy("page_id", F.col("y0").alias("y")).agg((F.max("x0") / 64).alias("slope")).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "slope"))).alias("k"))
    return knots.select("page_id", F.floor(Y.interpolate(F.col("k"), F.lit(333.0)) * 1_000_000 + 0.5).alias("slope"))


@query("median_gaps", "WITH " + WORDS_SQL + """, r AS (SELECT DISTINCT page_id, y0 AS yd FROM words), g AS (SELECT page_id, yd - lag(yd) OVER (PARTITION BY page_id ORDER BY yd) AS gap FROM r)
SELECT page_id, list_sort(list(gap))[count(*) // 2 + 1] AS gap FROM g WHERE gap > 0 AND gap < 26.4 GROUP BY page_id""")
def median_gaps(spark, d):
    rows = words(spark, d).select("page_id", F.col("y0").alias("yd"), F.lit(12.0).alias("h"), F.col("y0").alias("row_id")).distinct()
    return Y.median_gap(rows)


@query("cell_boxes", """
WITH c AS (SELECT o_orderkey AS stop_id, (o_orderkey % 900)::DOUBLE AS yd, (8 + o_orderkey % 8)::DOUBLE AS h FROM orders),
v(kind, variant, tall, along, scale) AS (VALUES ('label', 0, false, false, 2.0), ('label', 1, true, false, 2.0), ('number', 0, false, false, 2.0), ('number', 1, false, false, 3.0), ('number', 2, true, false, 2.0), ('number', 3, true, true, 2.0), ('number', 4, true, true, 2.5))
SELECT stop_id, kind, variant, floor(((CASE WHEN kind = 'number' THEN 660 ELSE 540 END) - (CASE WHEN kind = 'label' OR along THEN 320 ELSE 600 END) + 1.2::DOUBLE * h) * scale + 0.5)::BIGINT AS width,
       floor((2 * (CASE WHEN tall THEN 1.5::DOUBLE ELSE 0.62::DOUBLE END) * h + 1.2::DOUBLE * h) * scale::DOUBLE + 0.500001)::BIGINT AS height FROM c, v""")
def cell_boxes(spark, d):
    k = F.col("o_orderkey")
    cells = P.table(spark, d, "orders").select(k.alias("stop_id"), (k % 900).cast("double").alias("yd"), (k % 8 + 8).cast("double").alias("h"), F.lit(0.01).alias("slope"), F.lit(320.0).alias("label_x0"), F.lit(540.0).alias("label_x1"), F.lit(600.0).alias("number_x0"), F.lit(660.0).alias("number_x1"))
    return C.cell_boxes(cells).select("stop_id", "kind", "variant", "width", "height")


@query("pair_lines", """
WITH l AS (SELECT l_orderkey AS read_id, l_linenumber AS line_no, min(l_quantity) AS confidence, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN '41/ 40' WHEN 1 THEN '41' WHEN 2 THEN 'text' ELSE '35 40 text' END AS text FROM lineitem GROUP BY ALL)
SELECT read_id, any_value(text) AS text, any_value(confidence) AS confidence FROM l WHERE text = '41/ 40' GROUP BY read_id HAVING count(*) = 1""")
def pair_lines(spark, d):
    rows = P.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line_no")).agg(F.min("l_quantity").alias("confidence"))
    k = (F.col("read_id") + F.col("line_no")) % 4
    return C.pair_lines(rows.withColumn("text", F.when(k == 0, "41/ 40").when(k == 1, "41").when(k == 2, "text").otherwise("35 40 text")))
