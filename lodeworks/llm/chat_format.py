"""Chat formatting that is checked by a grammar round trip.

Template: ``conversation := turn*`` and
``turn := "<s>[INST]" role "[/INST]" text "</s>"``, where neither role nor text
holds a control string and both are read with the escapes ``&lt;``, ``&#91;`` and
``&amp;`` undone. The parser is deterministic and strict: a stray control string
makes the parse fail.

Rendering starts without escapes. The rendered conversation is parsed again and
compared with its source; turns that do not come back are escaped, and if the
conversation still differs, all its turns are, and the last rendering is parsed again
too: the job fails rather than give an output that does not parse into its source; ``rounds`` says how many renderings that took.

The loss mask marks the texts of one role; ``loss_spans`` are its code-point
spans in the formatted text, end exclusive.

Defined results: null texts and roles are empty; turns stand by turn (null
first), then role, then text, so ties and repeated rows have one order and all
stay; a null conversation id is one conversation; an empty table gives an empty
result; other columns are neither read nor returned. A conversation is one output
text, so its rows meet in one task whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import let, running

BEGIN, MID, END = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit(MID), turn["text"], F.lit(END))


def _clean(c: Column) -> Column:
    stray = F.contains(c, F.lit(CONTROL[0]))
    for x in CONTROL[1:]:
        stray = stray | F.contains(c, F.lit(x))
    return ~stray


def parse_turn(piece: Column) -> Column:
    """The turn in ``piece``, which is what stands before an end mark; null if it is none."""

    def read(body: Column) -> Column:
        at = F.instr(body, MID)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(MID))
        ok = F.startswith(piece, F.lit(BEGIN)) & (at > 0) & _clean(role) & _clean(text)
        return F.when(ok, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))

    return let(F.substr(piece, F.lit(len(BEGIN) + 1)), read)


def pieces(formatted: Column) -> Column:
    """What stands before each end mark; a rest after the last one makes a last piece that does not parse."""
    cut = F.split(formatted, END, -1)
    return let(cut, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def parse(formatted: Column) -> Column:
    """Array of turns; an element is null where the grammar is broken."""
    return F.transform(pieces(formatted), parse_turn)


def format_conversations(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv``, formatted, loss_spans, turns (read back), loss_text (read back) and rounds."""
    empty = F.lit("")
    t = rows.select(
        F.col(conv).alias("_conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text).cast("string"), empty).alias("text"),
        ).alias("_turn"),
    )
    c = t.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_rows"))
    c = c.withColumn("_source", F.transform("_rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    join = lambda turns: F.array_join(F.transform(turns, render), "")
    same = lambda formatted: parse(formatted).eqNullSafe(F.col("_source"))
    shield = lambda x: F.struct(escaped(x["role"]).alias("role"), escaped(x["text"]).alias("text"))
    alone = lambda x: parse(render(x)).eqNullSafe(F.array(x))
    c = c.withColumn("_first", join(F.col("_source"))).withColumn("_ok", same(F.col("_first")))
    some = F.transform("_source", lambda x: F.when(alone(x), x).otherwise(shield(x)))
    c = c.withColumn("_second", F.when(~F.col("_ok"), join(some))).withColumn("_ok2", F.col("_ok") | same(F.col("_second")))
    c = c.withColumn("_third", F.when(~F.col("_ok2"), join(F.transform("_source", shield))))
    every = F.when(same(F.col("_third")), F.col("_third")).otherwise(F.raise_error(F.lit("a conversation does not come back from its template")).cast("string"))
    c = c.withColumn("formatted", F.when(F.col("_ok"), F.col("_first")).when(F.col("_ok2"), F.col("_second")).otherwise(every))
    c = c.withColumn("rounds", F.when(F.col("_ok"), 1).when(F.col("_ok2"), 2).otherwise(3))
    c = c.withColumn("_pieces", pieces(F.col("formatted"))).withColumn("turns", F.transform("_pieces", parse_turn))
    # Spans of masked texts: from the mark in the middle of a piece to its end.
    ends = running(F.transform("_pieces", lambda p: F.length(p) + len(END)), lambda a, b: a + b, F.lit(0))

    def marked(at: Column) -> Column:
        every = F.transform(
            "_pieces", lambda p, i: F.struct((F.get(at, i) + F.instr(p, MID) - 1 + len(MID)).cast("long").alias("start"), (F.get(at, i) + F.length(p)).cast("long").alias("end"))
        )
        return F.filter(every, lambda x, i: F.get("turns", i)["role"] == loss_role)

    spans = let(ends, marked)
    lost = F.filter("turns", lambda x: x["role"] == loss_role)
    return c.select(
        F.col("_conv").alias(conv), "formatted", spans.alias("loss_spans"), "turns",
        F.array_join(F.transform(lost, lambda x: x["text"]), "").alias("loss_text"), "rounds",
    )
