"""Chat formatting: a finite-state machine over roles and a declarative template.

Only DataFrame functions are used.  A template gives each role a loss flag and marks every
turn as ``### <role>: <text></turn>\\n``; the machine's transitions say which role may follow
which state, and which states may end a conversation.  Formatting emits an array of text
segments with a loss flag each; their concatenation is the formatted conversation.

Control strings inside texts and roles are escaped: a backslash becomes ``\\b``, ``###``
becomes ``\\h``, ``</turn>`` becomes ``\\t`` and, in roles, ``:`` becomes ``\\c``.  Escaped text
holds none of the marks, every backslash in it starts a pair, so unescaping (pairs for marks
first, ``\\b`` last) restores it exactly.

Edge cases: null text and null role count as empty; turns are ordered by turn (nulls first),
ties by role, then text; repeated rows are turns of their own; a null ``conv_id`` is a
conversation of its own; unknown roles are formatted without loss and make the conversation
invalid; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Declares the marks, which roles carry loss, and the machine that validates turn order."""

    opening: str = "### "
    heading: str = ": "
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    final: tuple[str, ...] = ("assistant",)


CHAT = Template()
#: What stands for each control string in escaped text; the backslash is unescaped last.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replace_all(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replace_all(text, pairs)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return _replace_all(text, [(b, a) for a, b in reversed(pairs)])


def format_chats(rows: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, segments, formatted, state, valid, first_invalid_turn)``, a row per conversation.

    ``segments`` is an array of ``(text, loss)``; ``state`` is where the machine stops;
    ``first_invalid_turn`` counts from 0 and is null where every turn was allowed.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def emit(t: Column) -> Column:
        loss = t["role"].isin(list(template.loss_roles))
        head = F.concat(F.lit(template.opening), escape(t["role"], ROLE_ESCAPES), F.lit(template.heading))
        pieces = ((head, F.lit(False)), (escape(t["text"]), loss), (F.lit(template.closing), F.lit(False)))
        return F.array(*(F.struct(text.alias("text"), flag.alias("loss")) for text, flag in pieces))

    moves = F.create_map(*(F.lit(x) for a, role, b in template.transitions for x in (f"{a}\n{role}", b)))

    def step(s: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), t["role"]))
        stuck = s["bad"].isNotNull()
        bad = F.when(~stuck & to.isNull(), s["n"]).otherwise(s["bad"])
        return F.struct(F.when(stuck | to.isNull(), s["state"]).otherwise(to).alias("state"), bad.alias("bad"), (s["n"] + 1).alias("n"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    done = chats.select("conv_id", F.flatten(F.transform("turns", emit)).alias("segments"), F.aggregate("turns", begin, step).alias("m"))
    return done.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("m.state").alias("state"),
        (F.col("m.bad").isNull() & F.col("m.state").isin(list(template.final))).alias("valid"),
        F.col("m.bad").alias("first_invalid_turn"),
    )


def parse_formatted(formatted: Column, template: Template = CHAT) -> Column:
    """The array of ``(role, text)`` that a formatted conversation was made of."""
    # the closing mark ends every turn, so the last part is empty
    parts = F.filter(F.split(formatted, _quoted(template.closing)), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, F.lit(len(template.opening) + 1), F.length(p)))

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(template.heading))
        role = F.substring(p, F.lit(1), at - 1)
        text = F.substring(p, at + len(template.heading), F.length(p))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(body, turn)


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(rows.unionByName(probe))
    back = chats.withColumn("turns", parse_formatted(F.col("formatted")))
    # under the loss mask: the flagged segments, unescaped
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
        "first_invalid_turn",
    )


#: Stated from the rows alone: the marks add "### ", ": " and "</turn>\n", escapes what they must.  As a state is
#: named after the role that led to it, the machine stops before the first pair of neighbours that is not allowed.
OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT conv_id, role, row_number() OVER w - 1 AS place, lag(role, 1, 'start') OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), stopped AS (
  SELECT conv_id, min(place) FILTER ((before, role) NOT IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS bad
  FROM placed GROUP BY conv_id
), machine AS (
  SELECT p.conv_id, coalesce(max_by(p.role, p.place) FILTER (s.bad IS NULL OR p.place < s.bad), 'start') AS state, any_value(s.bad) AS bad
  FROM placed p JOIN stopped s ON p.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY p.conv_id
)
SELECT conv_id,
       count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
              + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')))::BIGINT AS formatted_chars,
       any_value(machine.state) AS state,
       any_value(machine.bad IS NULL AND machine.state = 'assistant') AS valid,
       any_value(machine.bad)::INTEGER AS first_invalid_turn
FROM t JOIN machine USING (conv_id) GROUP BY conv_id
"""
