"""Chat formatting with a grammar that is read back and compared to its source.

Grammar of a formatted conversation (turns follow each other with nothing between)::

    conversation = turn*
    turn = "[INST] " text " [/INST]"                      role user
         | "[SYS] " text " [/SYS]"                        role system
         | "<s>" text "</s>"                              role assistant; the text is under the loss mask
         | "[ROLE] " name " [/ROLE] " text " [/TURN]"     any other role

A control string inside a text (or name) would end a turn early or reach a tokenizer as a control token. A
first rendering takes texts as they are; it is reparsed, and where turns or the number of control strings
differ from the source, one backslash is put behind the first character of every control string, also of
those that hold backslashes there already. The parser takes one away, so the escape is exactly reversible.
``round_trip`` reports the final comparison.

Everything is built from SQL expressions. Rows are ordered by turn, ties by role and text; repeated rows are
repeated turns. Null role and text are empty, null turns come first, null conversation ids form one
conversation. Extra columns are ignored. A conversation is one record, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: fixed strings.
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<s>", "</s>")}
NAME_OPEN, NAME_CLOSE, TURN_CLOSE = "[ROLE] ", " [/ROLE] ", " [/TURN]"
_REST = r"(/?(?:INST|SYS|ROLE|TURN)\]|/?s>)"
CONTROL = r"([\[<])" + _REST
TO_ESCAPE = r"([\[<])(\\*)" + _REST
ESCAPED = r"([\[<])\\(\\*)" + _REST
TURN = (r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|<s>.*?</s>|\[ROLE\] .*? \[/ROLE\] .*? \[/TURN\]")
NAME_HEADER = r"(?s)^\[ROLE\] .*? \[/ROLE\] "


def escape(text: Column) -> Column:
    return F.regexp_replace(text, TO_ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _render(turns: Column, guard) -> Column:
    def one(t: Column) -> Column:
        text, role = guard(t["text"]), t["role"]
        out = F.concat(F.lit(NAME_OPEN), guard(role), F.lit(NAME_CLOSE), text, F.lit(TURN_CLOSE))
        for name, (start, end) in FRAMES.items():
            out = F.when(role == name, F.concat(F.lit(start), text, F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def _inner(piece: Column, start: Column, end: int) -> Column:
    """The text of a turn between a header of ``start`` characters and a close of ``end``."""
    return F.substring(piece, start + 1, F.length(piece) - start - end)


def _read(piece: Column) -> Column:
    """(role, text) of one turn."""
    header = F.regexp_extract(piece, NAME_HEADER, 0)
    name = unescape(_inner(header, F.lit(len(NAME_OPEN)), len(NAME_CLOSE)))
    out = F.struct(name.alias("role"), unescape(_inner(piece, F.length(header), len(TURN_CLOSE))).alias("text"))
    for role, (start, end) in FRAMES.items():
        text = unescape(_inner(piece, F.lit(len(start)), len(end)))
        out = F.when(F.startswith(piece, F.lit(start)), F.struct(F.lit(role).alias("role"), text.alias("text"))).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """Array of (role, text), read back from the formatted text alone."""
    return F.transform(pieces(formatted), _read)


def loss_spans(formatted: Column) -> Column:
    """Array of (start, end): the characters of the formatted text under the loss mask, end exclusive."""
    start, end = FRAMES["assistant"]
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, piece: Column) -> Column:
        after = acc["at"] + F.length(piece)
        span = F.struct((acc["at"] + len(start)).alias("start"), (after - len(end)).alias("end"))
        return F.struct(after.alias("at"), F.when(F.startswith(piece, F.lit(start)), F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces(formatted), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def _same(formatted: str, turns: str) -> Column:
    """Does the formatted column parse back to the turns, with no control string but the template's own?"""
    named = F.size(F.filter(F.col(turns), lambda t: ~t["role"].isin(*FRAMES)))
    controls = F.size(F.regexp_extract_all(F.col(formatted), F.lit(CONTROL), F.lit(0)))
    return ((parse(F.col(formatted)) == F.col(turns)) & (controls == 2 * F.size(turns) + named)
            & (F.array_join(pieces(F.col(formatted)), "") == F.col(formatted)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, loss_spans and round_trip of each conversation in ``rows`` (conv_id, turn, role, text)."""
    blank = F.lit("")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                    F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    source = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", _render(F.col("turns"), lambda t: t))
    tried = plain.withColumn("escaped", ~_same("plain", "turns"))
    out = tried.withColumn("formatted", F.when(F.col("escaped"), _render(F.col("turns"), escape)).otherwise(F.col("plain")))
    return out.select("conv_id", "formatted", "escaped", loss_spans(F.col("formatted")).alias("loss_spans"),
                      F.when(F.col("escaped"), _same("formatted", "turns")).otherwise(F.lit(True)).alias("round_trip"))
