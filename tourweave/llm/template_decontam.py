r"""Benchmark decontamination by template canonicalisation.

Only DataFrame functions are used.  A text's tokens are its runs of non-space characters (a
token of punctuation alone joins the one before).  A token has three forms, which depend on
the token alone (a unit also on a number right before it), never on where its sentence begins:

* ``folded``: lower-cased, without punctuation;
* ``slotted``: like that, with typed placeholders: numbers U+E000, names (a capitalised word that
  is not ``COMMON``) U+E001, units after a number U+E002;
* ``numbered``: placeholders for numbers and units, names folded.

Windows of ``WINDOW`` tokens of all documents, folded and slotted, are hash-joined with those of
the benchmark in all three forms (numbered ones are what a document in lower case has as slotted).
An item shorter than that is one window of its own length, so a text that holds a whole item is
found however short the item is; ``least_tokens`` leaves out items below it.  Folded windows are
all used; windows with placeholders that hardly have a literal word are not.

Hits are gathered per document, item and alignment (position in the document less position in
the item) and only find the alignment.  There the whole item is compared token by token; tokens
are alike if their folded or slotted forms agree.  It counts

* if the windows found, or all runs of ``WINDOW`` tokens that are alike, stretch over ``COVER``
  tokens or the whole item, and the slots (tokens with a placeholder) of that stretch agree:
  ``exact`` if all values do, ``template`` if each value of the item always stands for one value
  of the document and the reverse (a re-parameterised copy);
* else as ``exact``, if ``COVER`` tokens in a row or the whole item are alike with all values
  the same, whatever the slots elsewhere.

So a verbatim run of ``COVER`` tokens, or of a whole shorter item, is found at any place, in any case.

The windows of the benchmark, its items and the documents with hits are broadcast only if a count
finds them few (``BROADCAST_ROWS``); otherwise the joins shuffle.

Edge cases: null and empty texts match nothing; documents with a null id are matched like
others; rows that repeat id and text are one document; rows that share an id but not the text
are matched one by one and share the result row of their id; items that repeat an id are
separate texts under one id; empty tables give an empty result; other columns are ignored.
Every repetition in a pattern is possessive or of one character class, so that texts of any
length are read without recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, internal, table

WINDOW = 8
COVER = 13
#: A benchmark window with placeholders needs this many tokens without one.
LITERALS = 4
BROADCAST_ROWS = 1_000_000
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: English; the units of other languages are the caller's to pass.
UNITS = (
    "km", "cm", "mm", "m", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "meters", "metres", "meter", "metre", "kg", "g", "mg", "lb", "lbs",
    "tons", "ton", "grams", "gram", "l", "ml", "liters", "litres", "hours", "hour", "h", "minutes", "minute", "min", "seconds", "second", "s", "days",
    "day", "weeks", "week", "months", "month", "years", "year", "percent", "dollars", "dollar", "euros", "euro", "cents", "pounds", "mph", "kmh", "kwh", "w", "kw",
)

#: Words that are capitalised where they begin a sentence and are no names.
COMMON = (
    "The", "An?", "This", "That", "These", "Those", "There", "Here", "It", "Its", "He", "She", "They", "We", "You", "I", "His", "Her", "Their", "Our", "Your", "My",
    "What", "Which", "Who", "Whom", "Whose", "Where", "When", "Why", "How", "If", "In", "On", "At", "By", "For", "From", "With", "Without", "Of", "To", "As", "After", "Before",
    "During", "While", "Since", "Until", "Because", "Although", "Though", "Then", "Than", "Thus", "So", "But", "And", "Or", "Nor", "Not", "No", "Yes", "Each", "Every", "All", "Some",
    "Any", "Both", "Either", "Neither", "One", "Is", "Are", "Was", "Were", "Be", "Do", "Does", "Did", "Has", "Have", "Had", "Can", "Could", "Will", "Would", "Should", "Shall", "May",
    "Might", "Must", "Let", "Suppose", "Assume", "Given", "Find", "Compute", "Calculate", "Determine", "Consider", "Please",
)


def tokens_text(text: Column) -> Column:
    """The tokens with one space between."""
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.regexp_replace(spaced, r" (?=[^\p{L}\p{N} ]+(?: |\z))", "")


def folded(tokens: Column) -> Column:
    """Lower case without punctuation, with as many spaces as ``tokens_text``."""
    return F.regexp_replace(F.lower(tokens), r"[^\p{L}\p{N} ]+", "")


def marked(tokens: Column, units: Sequence[str] = UNITS) -> Column:
    """Like ``folded``, with placeholders for numbers and units, and ``NAME`` before each name."""
    # the look-behinds come after the letter, so that most places fail on one character class
    named = F.regexp_replace(tokens, r"(\p{Lu}(?<![\p{L}\p{M}\p{N}].)\p{Ll}[\p{L}\p{M}]*+)", f"{NAME}$1")
    named = F.regexp_replace(named, rf"{NAME}(?=(?:{'|'.join(COMMON)})(?![\p{{L}}\p{{M}}]))", "")
    number = r"\p{N}++(?:[.,:/]\p{N}++)*+"
    # a chain of numbers is tried from its start only, or a long one without a unit would take quadratic time
    chain = r"\p{N}(?<!\p{N}.)(?<!\p{N}[.,:/].)\p{N}*+(?:[.,:/]\p{N}++)*+"
    measured = F.regexp_replace(F.lower(named), rf"{chain}( ?)(?:{'|'.join(units)})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}") if units else F.lower(named)
    return F.regexp_replace(F.regexp_replace(measured, number, NUMBER), f"[^\\p{{L}}\\p{{N}} {NUMBER}-{UNIT}]+", "")


def numbered(marked_text: Column) -> Column:
    return F.replace(marked_text, F.lit(NAME), F.lit(""))


def slotted(marked_text: Column) -> Column:
    return F.regexp_replace(marked_text, rf"{NAME}[\p{{L}}\p{{N}}]*+", NAME)


def _tokens(name: str) -> Column:
    return F.when(F.length(name) > 0, F.split(name, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(name: str) -> Column:
    return F.transform(_tokens(name), lambda t: F.xxhash64(t))


def windows(hashes: Column, size: int, stride: int = 1) -> Column:
    """A hash of each window of ``size`` tokens that starts at a multiple of ``stride``, of the hashes of its tokens."""
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    # item by item: a slice copies the whole array each time; the hash of an array is the same
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))


def _open(token: Column) -> Column:
    return token.rlike(f"[{NUMBER}-{UNIT}]")


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """``(form, size, stride, item_key, whole, item_pos, h)``: folded windows, and slotted and numbered ones as ``slotted``.

    ``whole`` is the item's size, ``stride`` how far apart windows of a document may be to meet all copies.
    """
    n = F.size("folded")

    def of(form: str, size: Column, *columns: str) -> DataFrame:
        starts = lambda c: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(i.alias("at"), F.slice(c, i, size).alias("w")))
        rows = items.where(n > 0).select(F.lit(form).alias("form"), size.alias("size"), "item_key", n.alias("whole"), F.explode(F.array_distinct(F.concat(*map(starts, columns)))).alias("x"))
        literal = F.size(F.filter("x.w", lambda t: (t != "") & ~_open(t)))
        return rows.select("form", "size", "item_key", "whole", (F.col("x.at") - 1).alias("item_pos"), F.xxhash64(F.transform("x.w", lambda t: F.xxhash64(t))).alias("h"), literal.alias("literal"))

    rows = of("slotted", F.least(F.lit(WINDOW), n), "slotted", "numbered")
    # placeholders alone would match any number or name
    enough = F.greatest(F.lit(1), F.least(F.lit(LITERALS), F.max("literal").over(Window.partitionBy("item_key"))))
    rows = rows.withColumn("enough", enough).where(F.col("literal") >= F.col("enough")).drop("enough")
    rows = rows.unionByName(of("folded", F.when(n < COVER, n).otherwise(WINDOW), "folded")).drop("literal").distinct()
    # a run of COVER tokens holds a window at a multiple of the stride; shorter items are one folded window
    return rows.withColumn("stride", F.when((F.col("form") == "folded") & (F.col("whole") >= COVER), COVER - WINDOW + 1).otherwise(1))


def _few(df: DataFrame) -> DataFrame:
    """``df`` (cut from its lineage), broadcast where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", units: Sequence[str] = UNITS, least_tokens: int = 1
) -> DataFrame:
    """``(doc_id, text_key, item_id, kind, covered, slots)``, a row per document and item that match."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens_text(F.col(item_text_col)).alias("raw")).where("raw <> ''").distinct()
    items = items.select("item_id", F.xxhash64("item_id", "raw").alias("item_key"), "raw", folded(F.col("raw")).alias("f"), marked(F.col("raw"), units).alias("m"))
    items = items.select("item_id", "item_key", "raw", "f", slotted(F.col("m")).alias("s"), numbered(F.col("m")).alias("n"))
    forms = {"raw": "item_raw", "f": "folded", "s": "slotted", "n": "numbered"}
    items = cut(items.select("item_id", "item_key", *(_tokens(a).alias(b) for a, b in forms.items())).where(F.size("item_raw") >= least_tokens))
    wanted = cut(_benchmark_windows(items))
    # at most WINDOW + COVER of them
    parts = sorted((r["form"], r["size"], r["stride"]) for r in wanted.select("form", "size", "stride").distinct().collect())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where("text <> ''")
    split = texts.select("doc_id", "text_key", tokens_text(F.col("text")).alias("raw")).select("doc_id", "text_key", folded(F.col("raw")).alias("f"), marked(F.col("raw"), units).alias("m"))
    split = split.select("doc_id", "text_key", "f", slotted(F.col("m")).alias("s")).select("doc_id", "text_key", _hashes("f").alias("hf"), _hashes("s").alias("hs"))
    columns = {"folded": "hf", "slotted": "hs"}
    found = [windows(F.col(columns[form]), size, stride) for form, size, stride in parts] or [windows(F.col("hf"), WINDOW)]
    # the size stands below the explode, which would else carry the whole array with every window
    split = split.select("doc_id", "text_key", F.size("hf").alias("n"), "hf", "hs")
    hits = split.select("doc_id", "text_key", "n", F.posexplode(F.concat(*found)).alias("at", "h")).join(_few(wanted), "h")
    # the windows of all parts stand in one array
    pos, before = F.lit(None).cast("int"), F.lit(0)
    for form, size, stride in parts:
        each = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / stride).cast("int") + 1).otherwise(0)
        here = (F.col("form") == form) & (F.col("size") == size) & (F.col("stride") == stride) & (F.col("at") >= before) & (F.col("at") < before + each)
        pos = F.when(here, (F.col("at") - before) * stride).otherwise(pos)
        before = before + each
    hits = hits.select("doc_id", "text_key", "item_key", "whole", "item_pos", "size", pos.alias("pos")).where("pos IS NOT NULL")
    aligned = hits.groupBy("doc_id", "text_key", "item_key", "whole", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("item_pos").alias("lo"), F.max(F.col("item_pos") + F.col("size")).alias("hi"))

    # only the documents that an alignment was found in are read again, to cut out what stands against the item
    a, b = internal("id"), internal("key")
    stretches = cut(aligned.groupBy(F.col("doc_id").alias(a), F.col("text_key").alias(b)).agg(F.collect_set(F.struct("item_key", "whole", "shift", "lo", "hi")).alias("found")))
    again = texts.join(_few(stretches), F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("text_key") == F.col(b)))
    again = again.select("doc_id", "text_key", tokens_text(F.col("text")).alias("raw"), "found")
    again = again.select("doc_id", "text_key", "raw", folded(F.col("raw")).alias("f"), slotted(marked(F.col("raw"), units)).alias("s"), "found")
    again = again.select("doc_id", "text_key", "found", *(_tokens(x).alias(y) for x, y in (("raw", "doc_raw"), ("f", "doc_folded"), ("s", "doc_slotted"))))

    def cut_out(hit: Column) -> Column:
        skip, end = F.greatest(F.lit(0), -hit["shift"]), F.least(hit["whole"], F.size("doc_raw") - hit["shift"])
        token = lambda i: F.struct(*(F.get(f"doc_{x}", hit["shift"] + i).alias(f"d{x[0]}") for x in ("raw", "folded", "slotted")))
        return F.struct(hit["item_key"].alias("item_key"), skip.alias("skip"), (hit["lo"] - skip).alias("lo"), (hit["hi"] - skip).alias("hi"), F.transform(F.sequence(skip, end - 1), token).alias("d"))

    there = again.select("doc_id", "text_key", F.explode(F.transform("found", cut_out)).alias("hit")).select("doc_id", "text_key", "hit.*").distinct().join(_few(items), "item_key")
    theirs = [F.slice(x, F.col("skip") + 1, F.size("d")).alias(f"i{y}") for x, y in (("item_raw", "r"), ("folded", "f"), ("slotted", "s"), ("numbered", "n"))]
    there = there.select("doc_id", "text_key", "item_id", F.size("item_raw").alias("whole"), "lo", "hi", F.arrays_zip(*(F.col(f"d.{x}").alias(x) for x in ("dr", "df", "ds")), *theirs).alias("tokens"))
    bare = lambda x: F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+\z", "")

    def compare(p: Column) -> Column:
        equal = p["df"] == p["if"]
        alike = equal | (p["ds"] == p["is"]) | (p["ds"] == p["in"])
        t, o = bare(p["ir"]), bare(p["dr"])
        # of a number its inner marks count, of other tokens they do not
        same = (t == o) | (equal & ~p["if"].rlike(r"\p{N}"))
        return F.struct(alike.alias("alike"), (alike & same).alias("same"), (alike & _open(p["is"])).alias("slot"), t.alias("t"), F.when(same, t).otherwise(o).alias("o"))

    there = there.withColumn("tokens", F.transform("tokens", compare))
    zero = F.struct(*(F.lit(0).alias(x) for x in ("at", "run", "alike", "most")), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(s: Column, p: Column) -> Column:
        """The longest run with all the same, and where runs of a window's size that are alike begin and end."""
        run, alike, at = F.when(p["same"], s["run"] + 1).otherwise(0), F.when(p["alike"], s["alike"] + 1).otherwise(0), s["at"] + 1
        long = alike >= F.least(F.lit(WINDOW), F.col("whole"))
        lo = F.when(long & (s["lo"] < 0), at - alike).otherwise(s["lo"])
        return F.struct(at.alias("at"), run.alias("run"), alike.alias("alike"), F.greatest(s["most"], run).alias("most"), lo.alias("lo"), F.when(long, at).otherwise(s["hi"]).alias("hi"))

    there = there.withColumn("m", F.aggregate("tokens", zero, step))
    pairs = lambda lo, hi: F.array_distinct(F.transform(F.filter(F.slice("tokens", lo + 1, hi - lo), lambda p: p["slot"]), lambda p: F.struct(p["t"].alias("t"), p["o"].alias("o"))))
    stretch = lambda lo, hi: F.struct(F.lit(True).alias("by_slots"), (hi - lo).alias("covered"), pairs(lo, hi).alias("s"))
    none = F.struct(F.lit(False).alias("by_slots"), F.col("m.most").alias("covered"), F.array().cast("array<struct<t:string,o:string>>").alias("s"))
    enough = lambda n: (n >= COVER) | (n >= F.col("whole"))
    wider = F.when(F.col("m.lo") >= 0, stretch(F.col("m.lo"), F.col("m.hi")))
    judged = there.select("doc_id", "text_key", "item_id", "whole", F.explode(F.array(F.when(enough(F.col("m.most")), none), stretch(F.col("lo"), F.col("hi")), wider)).alias("x"))
    judged = judged.where(F.col("x").isNotNull() & enough(F.col("x.covered"))).select("doc_id", "text_key", "item_id", "x.by_slots", "x.covered", "x.s")
    one_to_one = (F.size(F.array_distinct(F.transform("s", lambda p: p["t"]))) == F.size("s")) & (F.size(F.array_distinct(F.transform("s", lambda p: p["o"]))) == F.size("s"))
    same = F.forall("s", lambda p: p["t"] == p["o"])
    kind = F.when(same, "exact").when(one_to_one, "template")
    judged = judged.select("doc_id", "text_key", "item_id", kind.alias("kind"), "by_slots", "covered", F.size("s").alias("slots")).where("kind IS NOT NULL")
    best = F.max(F.struct("by_slots", (F.col("kind") == "exact").alias("exact"), "covered", F.col("slots"))).alias("best")
    out = judged.groupBy("doc_id", "text_key", "item_id").agg(best)
    return out.select("doc_id", "text_key", "item_id", F.when(F.col("best.exact"), "exact").otherwise("template").alias("kind"), F.col("best.covered").alias("covered"), F.col("best.slots").alias("slots"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, columns unchanged."""
    a, b = internal("id"), internal("key")
    bad = cut(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct())
    return docs.join(_few(bad), F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left_anti")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    exact = F.max((F.col("kind") == "exact").cast("int")) == 1
    return found.groupBy("doc_id", "item_id").agg(F.when(exact, "exact").otherwise("template").alias("kind"), F.max("covered").cast("long").alias("covered_tokens"))
