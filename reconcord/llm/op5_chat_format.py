r"""Chat formatting with a grammar round trip.

The rendered conversation follows the grammar

    conversation := turn*
    turn         := "<|" role flag "|>" "\n" text "</s>" "\n"
    flag         := "" | "\"

A deterministic parser splits at ``</s>``, reads the header and takes every
other control string for a mark of the template, not for text.  Rendering
starts with all turns as they are.  The text is parsed and compared with the
source; in a conversation that did not come back, each turn whose own rendering
does not come back is escaped and flagged, and the conversation is rendered and
parsed again, until it is identical.  Escaping rewrites ``\``, ``<``, ``[`` and
``|`` to ``\\``, ``\l``, ``\b`` and ``\p``, so that no control string is left;
the flag tells the parser to undo it.  A conversation that has not come back
after ``rounds`` renderings ends the query with an error; two suffice, as an
escaped turn holds no control string.

The loss mask is a list of spans [start, end) in code points of the rendered
text, one for each assistant text that is not empty.

Rows of one conversation are ordered by turn, then role, then text (ties and
repeated rows are kept).  A null role or text is empty, a null turn comes
first, and rows with a null conversation id form one conversation.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, END, FLAG = "<|", "|>\n", "</s>", "\\"
#: Further control strings of this and common templates.
CONTROL = ("<|", "|>", "<s>", "[INST]", "[/INST]")


def escape(c: Column) -> Column:
    """No ``<``, ``[`` or ``|`` is left, so no control string can begin or end inside a text."""
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Inverse of ``escape``; the doubled mark is set aside first."""
    hold = F.lit("\\0")
    for code, plain in ((F.lit("\\\\"), hold), (F.lit("\\l"), F.lit("<")), (F.lit("\\b"), F.lit("[")), (F.lit("\\p"), F.lit("|")), (hold, F.lit("\\"))):
        c = F.replace(c, code, plain)
    return c


def render(turns: Column) -> Column:
    """Text of an array of (role, text, escaped)."""

    def one(t: Column) -> Column:
        plain = F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END + "\n"))
        return F.when(t["escaped"], F.concat(F.lit(OPEN), escape(t["role"]), F.lit(FLAG + CLOSE), escape(t["text"]), F.lit(END + "\n"))).otherwise(plain)

    return F.concat_ws("", F.transform(turns, one))


def _pieces(text: Column) -> Column:
    """A rendered text cut after each turn: "\\n", header, text; what follows the last turn is no piece."""
    cut = F.split(F.concat(F.lit("\n"), text), END, -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def _header(piece: Column) -> Column:
    return F.substring(piece, F.lit(len(OPEN) + 2), F.instr(piece, CLOSE) - len(OPEN) - 2)


def _read(c: Column, flagged: Column) -> Column:
    """Text of a role or turn without the marks in it, its escapes undone if it is flagged."""
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return F.when(flagged, unescape(c)).otherwise(c)


def parse(text: Column) -> Column:
    """Turns read back from a rendered text: array of (role, text)."""

    def one(x: Column) -> Column:
        header, flagged = _header(x), F.endswith(_header(x), F.lit(FLAG))
        role = F.when(flagged, F.substring(header, F.lit(1), F.length(header) - 1)).otherwise(header)
        body = F.substring(x, F.instr(x, CLOSE) + len(CLOSE), F.length(x))
        return F.struct(_read(role, flagged).alias("role"), _read(body, flagged).alias("text"))

    return F.transform(_pieces(text), one)


def spans(text: Column, role: str) -> Column:
    """Spans (start, end, escaped) of the texts of ``role`` in a rendered text, read from its pieces."""
    sized = F.transform(_pieces(text), lambda x: F.struct(F.length(x).alias("n"), F.instr(x, CLOSE).alias("h"), _header(x).isin(role, role + FLAG).alias("hit"), (_header(x) == role + FLAG).alias("escaped")))
    # each piece begins with a line end; the first one is not in the text
    zero = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int,escaped:boolean>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["h"] + len(CLOSE) - 1, acc["at"] + x["n"]
        grown = F.when(x["hit"] & (start < end), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["escaped"].alias("escaped"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), grown.alias("spans"))

    return F.aggregate(sized, zero, add, lambda acc: acc["spans"])


def chat_format(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Rows (conv, formatted, turns, loss_spans), one for each conversation; ``turns`` (role, text) are those read back."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    df = conversations.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    df = df.select("conv", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), F.lit(False).alias("escaped"))).alias("source"))
    df = df.withColumn("formatted", render(F.col("source"))).withColumn("turns", parse(F.col("formatted")))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    for _ in range(1, rounds):
        back = F.col("turns").eqNullSafe(wanted)
        alone = lambda t: parse(render(F.array(t))).eqNullSafe(F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))))
        harder = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["escaped"] | ~alone(t)).alias("escaped")))
        df = df.withColumn("source", F.when(back, F.col("source")).otherwise(harder))
        df = df.withColumn("formatted", F.when(back, F.col("formatted")).otherwise(render(F.col("source"))))
        df = df.withColumn("turns", F.when(back, F.col("turns")).otherwise(parse(F.col("formatted"))))
    sure = F.when(F.col("turns").eqNullSafe(wanted), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not come back")).cast("string"))
    return df.select("conv", sure.alias("formatted"), "turns").select("conv", "formatted", "turns", spans(F.col("formatted"), "assistant").alias("loss_spans"))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    def one(s: Column) -> Column:
        own = F.substring(formatted, s["start"] + 1, s["end"] - s["start"])
        return F.when(s["escaped"], unescape(own)).otherwise(own)

    return F.concat_ws("", F.transform(loss_spans, one))
