"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before
it as context, in which only that reply is trained on.

A turn is written ``### role: text</turn>`` and a line end. Inside roles and texts a backslash becomes ``\\s``, the turn
mark ``###`` becomes ``\\h`` and the end mark ``</turn>`` becomes ``\\t``; roles also write ``:`` as ``\\c``. After that every
backslash begins one escape, so the marks stand only where the template put them, and unescape() is exact.

An example is a prefix of the formatted conversation, so its text is cut out of it only when the row is made. The output
is as large as the method demands: a conversation of n turns gives up to n examples of up to n turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
MARK, SEPARATOR, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, table: tuple = ESCAPES) -> Column:
    for plain, code in table:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, table: tuple = ROLE_ESCAPES) -> Column:
    for plain, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Rows conv_id, example (from 0), formatted, loss_start, loss_end (code points from 0, end exclusive), final.

    Turns are taken by (turn, role, text), nulls first; a null role or text is empty; repeated rows are turns of their
    own; rows without conv_id form one conversation. Where turns follow the last target turn, or there is none, a row
    without a loss span holds the whole conversation. final: the example covers the whole conversation. Other columns
    are ignored. An empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(MARK), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEPARATOR))
    turns = turns.select("conv_id", "turn", "role", "text", F.length(head).alias("head"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        "head", "piece", (F.col("role") == target).alias("trained"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "end", "head", "piece", "trained"))).alias("t"))

    def span(x: Column) -> Column:
        start = x["end"] - F.length(x["piece"]) + x["head"]
        return F.struct(x["end"].alias("end"), start.alias("loss_start"), (x["end"] - len(END)).alias("loss_end"))

    last = F.element_at("t", -1)
    nothing = F.lit(None).cast("long")
    rest = F.struct(last["end"].alias("end"), nothing.alias("loss_start"), nothing.alias("loss_end"))
    examples = F.transform(F.filter("t", lambda x: x["trained"]), span)
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("whole"),
        last["end"].alias("total"),
        F.when(last["trained"], examples).otherwise(F.concat(examples, F.array(rest))).alias("examples"),
    )
    each = whole.select("conv_id", "whole", "total", F.posexplode("examples").alias("example", "x"))
    return each.select(
        "conv_id", "example",
        F.col("whole").substr(F.lit(1), F.col("x.end").cast("int")).alias("formatted"),
        "x.loss_start", "x.loss_end", (F.col("x.end") == F.col("total")).alias("final"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.locate(SEPARATOR, piece)
        return F.struct(
            unescape(piece.substr(F.lit(len(MARK) + 1), at - len(MARK) - 1)).alias("role"),
            unescape(piece.substr(at + len(SEPARATOR), F.length(piece)), ESCAPES).alias("text"),
        )

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts and loss spans: a row per conversation."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.col("formatted").substr((F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    read = examples.select(
        "conv_id", "example",
        F.when(F.col("final"), parsed_turns(F.col("formatted"))).alias("turns"),
        unescape(loss, ESCAPES).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    read = read.select("conv_id", "example", F.size("turns").cast("long").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(turns, 256)).alias("sha"), "loss", "chars")
    all_loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    found = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        all_loss.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
