r"""Chat formatting with Spark expressions only.

Template: a block for each run of turns with the same role, ``### role`` and a line end, then each turn's text
followed by ``</turn>``; blocks are separated by a line end. Inside texts and roles the backslash and the control
strings are escaped, so that neither occurs there and the output can be read back exactly:

    \      becomes  \0
    ###    becomes  \1
    </turn> becomes \2
    a line end in a role becomes \3

Turns are collected as structs by conversation and sorted; adjacent turns of one role become one block by slicing
the sorted array at the role changes. Where texts start is a running sum of lengths over the same partitioning, so
all work is linear in a conversation's length and the conversations are shuffled once. The output of a conversation
is one string, so a conversation must fit into a task; its window and sort can spill before that.

Defined results: a null text is empty and a null role is an empty role; a null conversation id is a conversation;
turns are ordered by turn (null first), then role, then text, and repeated rows are all kept; no rows give no
rows; other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, TURN_END, BLOCK_END = "### ", "</turn>", "\n"
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\3"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, safe in escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """From (conv_id, turn, role, text) rows one row for each conversation.

    conv_id, blocks array<struct<role, texts>> (escaped), formatted string, and loss_spans
    array<struct<start, end>>: code point offsets into formatted (end exclusive) of the ``loss_role`` texts.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("before", F.lag("role").over(order))
    rows = rows.withColumn("new", F.col("before").isNull() | (F.col("before") != F.col("role")))
    rows = rows.withColumn("r", escaped(F.col("role"), ROLE_ESCAPES)).withColumn("t", escaped(F.col("text")))
    block = F.concat(F.when(F.col("pos") > 1, BLOCK_END).otherwise(""), F.lit(HEADER), F.col("r"), F.lit("\n"))
    rows = rows.withColumn("head", F.when(F.col("new"), block).otherwise(""))
    whole = (F.length("head") + F.length("t") + len(TURN_END)).cast("long")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(whole).over(upto) - F.length("t") - len(TURN_END))
    item = F.struct("pos", "new", "r", "t", "head", "start", (F.col("role") == loss_role).alias("loss"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    starts = F.transform(F.filter("turns", lambda x: x["new"]), lambda x: x["pos"])
    chats = chats.withColumn("starts", F.concat(starts, F.array(F.size("turns") + 1)))
    cut = lambda p, i: F.struct(
        F.element_at("turns", p)["r"].alias("role"),
        F.transform(F.slice(F.col("turns"), p, F.element_at("starts", i + 2) - p), lambda x: x["t"]).alias("texts"),
    )
    chats = chats.withColumn("blocks", F.transform(F.slice(F.col("starts"), 1, F.size("starts") - 1), cut))
    part = lambda b: F.concat(F.lit(HEADER), b["role"], F.lit("\n"), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(TURN_END))), ""))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["t"])).alias("end")))
    return chats.select("conv_id", "blocks", F.array_join(F.transform("blocks", part), BLOCK_END).alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Read formatted chats back: conv_id, formatted, turns array<struct<role, text>> and loss_texts array<string>.

    Everything comes from ``formatted`` and ``loss_spans``; nothing of the original rows is used.
    """
    body = F.filter(F.split("formatted", HEADER), lambda x, i: i > 0)

    def turns_of(block: Column) -> Column:
        role = unescaped(F.substring_index(block, "\n", 1), ROLE_ESCAPES)
        rest = F.substring(block, F.length(F.substring_index(block, "\n", 1)) + F.lit(2), F.length(block))
        texts = F.split(rest, TURN_END)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    under_mask = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(body, turns_of)).alias("turns"), under_mask.alias("loss_texts"))
