"""The cells of a delivery row that are read again: where they are, and what counts of a reading.

A cell is a box on the page; a variant is one way to look at it.  ``cells(stop_id, yd, h, slope,
label_x0, label_x1, number_x0, number_x1)`` gives both boxes of a stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import delivery as D

#: Fixed values per kind and variant: tall strip, follows the line, starts at the label, several
#: lines, zoom, darkness threshold.
VARIANTS = (
    ("label", 0, False, False, False, False, 2.0, 165),
    ("label", 1, True, True, False, False, 2.0, 165),
    ("number", 0, False, False, False, False, 2.0, 165),
    ("number", 1, False, False, False, False, 3.0, 135),
    ("number", 2, True, False, False, True, 2.0, 165),
    ("number", 3, True, True, True, False, 2.0, 165),
    ("number", 4, True, True, True, False, 2.5, 180),
)
HALF, TALL_HALF, MARGIN, PAD = 0.62, 1.5, 0.6, 0.4
#: A lone number counts only in this part of its cell.
LONE_SHARE = 0.45


def cell_boxes(cells: DataFrame, asked: tuple[Column, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every variant of a stop's two cells, with the size of its picture and the part that is kept; only the ``asked`` kind and variant of a row if that is given.  ``keep`` names further columns of ``cells``."""
    fields = ("kind", "variant", "tall", "follow", "along", "block", "scale", "threshold")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, row))) for row in VARIANTS))
    if asked is not None:
        table = F.filter(table, lambda v: (v["kind"] == asked[0]) & (v["variant"] == asked[1]))
    c = cells.withColumn("v", F.explode(table)).select("*", "v.*").drop("v")
    number, h, s = F.col("kind") == "number", F.col("h"), F.col("scale")
    c = c.withColumn("cell_x0", F.when(number, F.col("number_x0")).otherwise(F.col("label_x0"))).withColumn("x1", F.when(number, F.col("number_x1")).otherwise(F.col("label_x1")))
    c = c.withColumn("x0", F.when(F.col("along"), F.col("label_x0")).otherwise(F.col("cell_x0"))).withColumn("half", h * F.when(F.col("tall"), TALL_HALF).otherwise(HALF)).withColumn("margin", h * MARGIN)
    m, rounded = F.col("margin"), lambda x: F.floor(x + 0.5)
    inner = F.when(F.col("follow"), F.col("half") - h * HALF).otherwise(F.lit(0.0))
    return c.select(
        "stop_id", *keep, "kind", "variant", "block", "follow", "threshold", "scale", "x0", "x1", "yd", "half",
        rounded((F.col("x1") - F.col("x0") + 2 * m) * s).alias("width"), rounded((2 * F.col("half") + 2 * m) * s).alias("height"), rounded(h * PAD * s).alias("pad"),
        ((m + F.col("cell_x0") - F.col("x0")) * s).alias("keep_x0"), ((m + F.col("x1") - F.col("x0")) * s).alias("keep_x1"),
        ((m + inner) * s).alias("keep_y0"), ((m + 2 * F.col("half") - inner) * s).alias("keep_y1"),
        F.array(s, -F.col("slope") * s, F.lit(0.0), s, -(F.col("x0") - m) * s, (F.col("half") + m - F.col("yd")) * s).alias("transform"),
    )


def pair_lines(lines: DataFrame) -> DataFrame:
    """The only line of a reading that shows a pair: ``lines(read_id, line_no, text, confidence)``.
    Readings with none, or several, are left out; a missing confidence is 0."""
    pairs = lines.where(D.is_pair(F.col("text")) & D.delivered_number(F.col("text")).isNotNull())
    found = pairs.groupBy("read_id").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return found.where("n = 1").drop("n")


def lone_number(words: Column, text: Column, other_rows: Column, keep_x0: Column, keep_x1: Column, pad: Column) -> Column:
    """Whether a number without a pair may count: no other delivery row, all digits in the left part of the cell."""
    digits = F.filter(words, lambda w: w["text"].rlike(r"\d"))
    left = F.forall(digits, lambda w: ((w["x0"] + w["x1"]) / 2 - pad - keep_x0) / (keep_x1 - keep_x0) < LONE_SHARE)
    return F.coalesce(D.delivered_number(text).isNotNull() & (other_rows == 0) & (F.size(digits) > 0) & left, F.lit(False))
