"""Text normalisation as column expressions.

White space is what the browsers' ``\\s`` holds (also the no-break space); word borders are
ASCII, so that an umlaut ends a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the imported texts, and accented letters with their bases.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįńňőōřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiinnoorsstuuuzzz"


def word(pattern: str) -> str:
    """The pattern between ASCII word borders."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")
    return F.trim(spaced)


def join_parts(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(separator, *(blank_to_null(p) for p in parts))


def plain_letters(c: Column) -> Column:
    """Lower case without accents, only a-z and 0-9; the sharp s is two letters."""
    lowered = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_replace(F.replace(lowered, F.lit("ß"), F.lit("ss")), "[^a-z0-9]", "")


def street_key(c: Column) -> Column:
    """Like ``plain_letters``, with umlauts spelled out and the abbreviated street word completed."""
    spelled = F.lower(F.coalesce(c, F.lit("")))
    for umlaut, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        spelled = F.replace(spelled, F.lit(umlaut), F.lit(letters))
    return F.regexp_replace(plain_letters(spelled), r"str\z", "strasse")


def confusable_key(c: Column) -> Column:
    """Street keys that differ only by letters which scans confuse are equal here."""
    return F.translate(c, "l10", "iio")


def key_part(c: Column) -> Column:
    return F.lower(collapse(c))


def house_number(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+", "")


def address_key(country: Column, address: Column, postal: Column) -> Column:
    """One text that is equal exactly for equal country, address and postal line."""
    return F.to_json(F.array(F.coalesce(country, F.lit("")), key_part(address), key_part(postal)))


def split_address(c: Column) -> Column:
    """``(street, house)``; empty where the text does not end in a house number."""
    pattern = r"(?i)^(.*?)\s+(\d+\s*[a-z]?(?:\s*[-/]\s*\d+[a-z]?)?)\z"
    text = collapse(c)
    return F.struct(F.regexp_extract(text, pattern, 1).alias("street"), F.regexp_extract(text, pattern, 2).alias("house"))


def postal_code(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), word(r"\d{4,5}"), 0)


def core(c: Column) -> Column:
    """Lower case a-z only, umlauts as their bases."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "äöü", "aou"), "[^a-z]", "")


def clean_line(c: Column) -> Column:
    """A line of an imported list: rules become spaces, dashes hyphens, white space collapses."""
    return collapse(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|+", " "), "–—", "--"))


def upper_median(values: Column) -> Column:
    """The middle element of an array, the upper one of an even number; null if it is empty."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_component(c: Column) -> Column:
    """Percent encoding as in the query part of a navigation address."""
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(F.url_encode(c) if a == "+" else c, F.lit(a), F.lit(b))
    return c


def driving_time(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    long_ = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" Std. "), (minutes % 60).cast("string"), F.lit(" Min."))
    return F.when(minutes < 1, "< 1 Min.").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" Min."))).otherwise(long_)


def kilometres(metres: Column) -> Column:
    """At most one decimal, a comma before it, no-break spaces between thousands."""
    text = F.format_number(F.floor(metres / 100 + 0.5) / 10, 1)
    return F.regexp_replace(F.translate(text, ",.", "\u00a0,"), r",0\z", "")
