"""Secret scans over an incremental, content-addressed blob ledger.

A path is a row with a text version.  A version's address is the SHA-256 of its UTF-8 text.
The ledger has one row per ``(blob, rule, version)`` that was ever scanned, with the spans
found (also none).  A scan hands a blob to the patterns only for the rule versions that the
ledger lacks, each distinct content once however many paths carry it, and joins the findings
back to all paths by address.

Spans are ``(kind, start, end)`` in code points, end exclusive; each kind is searched from
the left without overlaps over the whole text.

Of the ledger only the rows of the batch's blobs are grouped.  Ledger rows that repeat a (blob,
rule, version), as two writers or a retried append leave them, count once.

Edge cases: null text counts as empty (no findings); repeated rows are returned once each;
a null ``doc_id`` is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import internal, table, text_or_empty


@dataclass(frozen=True)
class Kind:
    """One kind of secret: a pattern, and what a match of it must satisfy besides."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    #: The group whose span counts.
    span: int = 0

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        find, group, least, span = re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0)).finditer, self.group, self.least, self.span
        return lambda text: [m.span(span) for m in find(text) if m.end(group) - m.start(group) >= least]


@dataclass(frozen=True)
class Rule:
    """A named, versioned set of kinds; a new version is scanned anew."""

    name: str
    version: int
    kinds: tuple[Kind, ...]


BASE = Rule(
    "base",
    1,
    (
        # a failing match uses up its text, so the length is tested after the match
        Kind("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
        # for these a minimum within the pattern finds the same spans: a match is a maximal run
        Kind("access", r"AKIA[A-Z0-9]{12,}"),
        Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
    ),
)
# a key's header fields and lines of base64, also quoted or with escaped line ends
_BREAK = r"""(?:\\[nrt]|[\s>|"',;#*])"""
_BODY = rf"""(?:{_BREAK}*+[A-Z][A-Za-z]*+-[A-Za-z-]++:[^\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_BREAK}++[A-Za-z0-9+/]++(?:={{1,2}}|(?=\s*(?:\\[nr]|["'\n]|\Z))))?+"""
EXTENDED = Rule(
    "extended",
    2,
    (
        # to the matching end line; where that is missing, to the end of the base64
        Kind("pem", rf"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----|{_BODY})"),
        # each run of token characters is tried once, from its first start: what fails there fails at the later ones too
        Kind("jwt", r"(?<![A-Za-z0-9_-])(?>(?:[A-Za-z0-9_-]*?-)??(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", span=1),
        Kind("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ),
)
RULES: tuple[Rule, ...] = (BASE, EXTENDED)

LEDGER = "blob string, rule string, version int, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_spans(text: str, rule: Rule) -> list[tuple[str, int, int]]:
    return [(k.name, a, b) for k in rule.kinds for a, b in k.finder()(text)]


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger rows that are missing for ``paths(blob, text)``: each unseen blob and rule version once."""
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = [f"{r.name}:{r.version}" for r in rules]
    if ledger is not None:
        done = ledger.join(blobs.select("blob"), "blob", "left_semi").select("blob", F.concat_ws(":", "rule", "version").alias("r")).where(F.col("r").isin(wanted)).groupBy("blob").agg(F.collect_set("r").alias("done"))
        blobs = blobs.join(done, "blob", "left")
    else:
        blobs = blobs.withColumn("done", F.lit(None).cast("array<string>"))
    blobs = blobs.withColumn("rules", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("done", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    finders = {f"{r.name}:{r.version}": (r.name, r.version, [(k.name, k) for k in r.kinds]) for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {key: (name, version, [(kind, k.finder()) for kind, k in kinds]) for key, (name, version, kinds) in finders.items()}
        for b in batches:
            out: list[list] = [[], [], [], []]
            for blob, text, due in zip(*(b.column(c).to_pylist() for c in ("blob", "text", "rules"))):
                for key in due:
                    name, version, kinds = ready[key]
                    spans = [{"kind": kind, "start": s, "end": e} for kind, find in kinds for s, e in find(text)]
                    for column, value in zip(out, (blob, name, version, spans)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], _SPANS)], ["blob", "rule", "version", "spans"])

    return blobs.select("blob", "text", "rules").mapInArrow(run, LEDGER)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """``(findings, fresh)``.

    ``findings(doc_id, blob, spans)`` has a row per row of ``docs`` with all spans by start,
    then kind in the order of the rules, then end; ``fresh`` has the rows to append to the ledger.
    """
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    fresh = scan_unseen(paths, ledger, rules)
    known = fresh
    if ledger is not None:
        in_use = F.concat_ws(":", "rule", "version").isin([f"{r.name}:{r.version}" for r in rules])
        known = fresh.unionByName(ledger.where(in_use).join(paths.select("blob"), "blob", "left_semi").select(*fresh.columns))
    return paths.select("doc_id", "blob").join(by_blob(known, rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans")), fresh


def by_blob(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(blob, spans)`` in order, for the blobs that have any."""
    order = F.create_map(*(F.lit(x) for pair in ((k.name, i) for i, k in enumerate(k for r in rules for k in r.kinds)) for x in pair))
    scans = F.collect_set(F.struct("rule", "version", "spans"))
    one = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.transform(scans, lambda s: s["spans"])).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return one.select("blob", F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def update_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Append what is unseen to the ledger at ``path`` (a shared folder), then return the findings.

    One writer at a time.  A rerun after a failure finds the appended rows and scans the rest.
    """
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    _, fresh = scan(docs, id_col, text_col, spark.read.schema(LEDGER).parquet(path) if there else None, rules)
    fresh.write.mode("append").parquet(path)
    return scan(docs, id_col, text_col, spark.read.schema(LEDGER).parquet(path), rules)[0]


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one mark, of the first kind."""
    found = by_blob(scan_unseen(docs.select(text_or_empty(text_col).alias("text")).withColumn("blob", F.sha2("text", 256)), None, rules), rules)
    blob, spans = internal("blob"), internal("spans")
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(blob, F.sha2(text_or_empty(text_col), 256)).join(found, blob, "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], gap).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    cleaned = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(cleaned)).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in BASE.kinds]))
    return findings.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
