"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted by (turn, role, text); runs of one role are
merged into one block; a conversation is the concatenation of its blocks::

    <|im_start|>role<|im_sep|>text<|im_sep|>next text of the same role<|im_end|>\n

``segments`` are the pieces of ``formatted`` in order with the loss mask: exactly the texts of the
assistant's turns are under it. Control strings inside roles and texts (this template's and the common
``<s> </s> [INST] [/INST]``) get a backslash after their first character, and one more where some
stand there already, so a text never holds a control string and the escape can be undone exactly.

Null text and null role are empty; a null conv_id is one conversation; repeated rows are turns of their
own; ties in ``turn`` go by role, then text. Extra columns are ignored. A conversation is one output
row, so its size is bounded by what one row may hold; that is the format's own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_TAIL = r"(s>|/s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, segments`` (array of text, loss) from ``conv_id, turn, role, text``."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.get("ts", i - 1)["role"] != F.get("ts", F.greatest(i - 2, F.lit(0)))["role"]))
    convs = convs.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, j: F.slice("ts", s, F.coalesce(F.get("starts", j + 1), n + 1) - s))
    convs = convs.withColumn("blocks", blocks)

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def turn(t: Column, i: Column) -> Column:
        gap = F.when(i == 0, F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).otherwise(F.lit(SEP))
        return F.array(piece(gap, F.lit(False)), piece(escape(t["text"]), t["role"] == loss_role))

    segments = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.flatten(F.transform(b, turn)), F.array(piece(F.lit(END), F.lit(False))))))
    convs = convs.select("conv_id", segments.alias("segments"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(START) + 1)), r"<\|im_sep\|>", -1)
        return F.transform(F.slice(parts, 2, F.size(parts) - 1),
                           lambda x: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output: turns, their digest, and the text under the loss mask."""
    out = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                           read_back(F.col("formatted")).alias("ts"),
                           F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                                    lambda s: unescape(s["text"])), "").alias("loss"))
    told = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("ts").cast("long").alias("n_turns"),
                      F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
