"""Prefix-target expansion of conversations into training examples, in columns only.

Every assistant turn becomes an example: all turns before it as context, then the reply, which alone is
trainable. A conversation that does not end with a reply gives one more example without a target, so
that every turn can be read back.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts ``<|`` is written
``<||``, so no content can spell a control string, and a line feed inside a role is ``<|nl|>``. Both are
undone exactly.

Defined results
* order: turn, then role, then text, nulls first; repeated rows are turns of their own;
* null text or role: empty; null conversation id: one conversation of its own;
* an empty table gives no example; other columns are ignored.

The contexts of a conversation of n turns add up to its length times its replies; that is what the
method asks for. They are made one row at a time. A digest of a whole conversation needs its text in
one row, so a conversation must fit into memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """``(conv, example, formatted, mask_start, mask_end)``; the mask is a code point range, null without a target."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    tail = F.lit(f"{END}\n")
    rows = rows.withColumn("body", body).withColumn("piece", F.concat(head, F.col("body"), tail))
    rows = rows.withColumn("pieces", F.collect_list("piece").over(so_far)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    is_target = F.col("role") == target
    made = rows.where(is_target | F.col("last")).select(
        "conv_id", F.size("pieces").alias("example"), F.concat_ws("", "pieces").alias("formatted"), "body", is_target.alias("is_target")
    )
    end = F.length("formatted") - len(END) - 1
    return made.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("is_target"), end - F.length("body")).alias("mask_start"),
        F.when(F.col("is_target"), end).alias("mask_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), control strings undone."""

    def one(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the mask covers, control strings undone; empty without a mask."""
    return F.coalesce(unescape(F.substring(formatted, start + 1, end - start)), F.lit(""))
