r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := text "</s>"                          an assistant's
                  | "[INST] " role "\n" text " [/INST]"  anyone else's
    text         := characters without the control strings <s> </s> [INST] [/INST]

Inside a text a backslash after the first character of a control string is an escape: the parser takes
away one backslash from "<\s>", "<\\s>", "[\/INST]" and so on. Each turn is rendered as it is and
parsed again; if the parser fails (a bare control string) or finds another text or role, the turn is
rendered with one more backslash in each such string, which the parser always takes back. Then the
whole conversation is parsed, and must give the source's turns; anything else is an error.

A role that isn't plain letters, digits, "_", "." or "-" is written as "x:" and its bytes in hex.

Defined cases: null text and null role are empty; rows of a conversation are in the order of turn (null
first), then role, then text; repeated rows are repeated turns; a null conv_id is a conversation of its
own; very long texts are formatted whole; an empty table gives an empty result; other columns of the input are ignored. One conversation is
one row, as its digests need all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import table

ASSISTANT = "assistant"
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
#: A control string, with any number of escapes in it.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
BARE = r"[<\[]/?(?:s>|INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.when(role.rlike(r"\A[A-Za-z0-9_.-]*\z"), role).otherwise(F.concat(F.lit("x:"), F.hex(F.encode(role, "UTF-8"))))


def _role_in(role: Column) -> Column:
    return F.when(role.startswith("x:"), F.decode(F.unhex(F.substring_index(role, "x:", -1)), "UTF-8")).otherwise(role)


def render_turn(role: Column, text: Column) -> Column:
    """text: already escaped where it has to be."""
    return F.when(role == ASSISTANT, F.concat(text, F.lit(END))).otherwise(F.concat(F.lit(OPEN), _role_out(role), F.lit("\n"), text, F.lit(CLOSE)))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn; null where it isn't of the grammar."""
    own = F.when(turn.endswith(END), F.substring(turn, F.lit(1), F.length(turn) - len(END)))
    other = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn) - len(OPEN) - len(CLOSE))
    line = F.instr(other, "\n")
    text = F.when(own.isNotNull(), own).otherwise(F.substring(other, line + 1, F.length(other)))
    role = F.when(own.isNotNull(), F.lit(ASSISTANT)).otherwise(_role_in(F.substring(other, F.lit(1), line - 1)))
    good = own.isNotNull() | (turn.startswith(OPEN) & turn.endswith(CLOSE) & (line > 0))
    return F.when(good & ~text.rlike(BARE), F.struct(role.alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of struct(role, text)."""
    pieces = F.split(formatted, r"(?<=</s>)|(?<= \[/INST\])")
    return F.transform(F.filter(pieces, lambda p: p != ""), parse_turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as parsed from it). rows: conv_id, turn, role, text."""
    turn = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = parse_turn(render_turn(F.col("role"), F.col("text")))
    same = F.coalesce((plain["role"] == F.col("role")) & (plain["text"] == F.col("text")), F.lit(False))
    safe = turn.withColumn("out", render_turn(F.col("role"), F.when(same, F.col("text")).otherwise(escape(F.col("text")))))
    whole = safe.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "out"))).alias("source"))
    formatted = whole.withColumn("formatted", F.array_join("source.out", "")).withColumn("turns", parse(F.col("formatted")))
    agrees = F.coalesce((F.col("turns.role") == F.col("source.role")) & (F.col("turns.text") == F.col("source.text")), F.lit(False))
    checked = F.when(agrees, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("conversation can't be read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return formatted.select("conv_id", "formatted", checked.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark, sf_dir) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, ASSISTANT, hard)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(given.unionByName(added)))


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
         + CASE WHEN role = 'assistant' THEN 4
                WHEN regexp_full_match(role, '[A-Za-z0-9_.-]*') THEN 16 + length(role)
                ELSE 18 + 2 * strlen(role) END AS out_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(out_chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
