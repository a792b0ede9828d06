"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its
text is trainable.  Turns after the last assistant turn (or a conversation without one) give one
more example that has nothing to train on, so the output holds every turn.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles and texts a
backslash is doubled, and a control string (the marks' opening ``<|`` and those of other common
templates) gets one backslash after its first character; ``unescape`` inverts both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks and the control strings that texts may not contain unescaped.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"([<\[])(\||/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\||/?s>|</?SYS>>|/?INST\])"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns in order (by turn, then role, then text)."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def examples(conversations: DataFrame, **columns: str) -> DataFrame:
    """conv_id, example (from 0), n_context, formatted, loss_start, loss_length (code points).

    Null roles and texts count as empty, null conversation ids form one conversation, a null turn
    comes first, equal rows are turns of their own, and an empty table gives no rows.  Only the four
    named columns are read.  One conversation is one row here, so it has to fit in a task; its
    examples are made one at a time.
    """
    marked = turns(conversations, **columns).select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("target"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    marked = marked.select(
        "conv_id", "heads", "bodies",
        F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))).alias("segments"),
        F.size("bodies").alias("n"),
        F.filter(
            F.sequence(F.lit(0), F.size("bodies")),
            lambda i: F.coalesce(F.get("target", i), ~F.coalesce(F.get("target", i - 1), F.lit(False))),
        ).alias("at"),
    )
    rows = marked.select("conv_id", "heads", "bodies", "segments", "n", F.posexplode("at").alias("example", "i"))
    context = F.array_join(F.slice("segments", F.lit(1), F.col("i")), "")
    rows = rows.select("conv_id", "example", F.col("i").alias("n_context"), context.alias("context"), F.get("heads", "i").alias("head"), F.get("bodies", "i").alias("body"))
    return rows.select(
        "conv_id", "example", "n_context",
        F.when(F.col("body").isNull(), F.col("context")).otherwise(F.concat("context", "head", "body", F.lit(END))).alias("formatted"),
        (F.length("context") + F.coalesce(F.length("head"), F.lit(0))).alias("loss_start"),
        F.coalesce(F.length("body"), F.lit(0)).alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    pieces = F.split(formatted, START.replace("|", r"\|"))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation what the examples hold: conv_id, turns, loss_text, formatted_chars, n_examples."""
    reply = unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_length")))
    held = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("loss_length") > 0, F.struct("example", reply.alias("text"))))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return held.select("conv_id", parse(F.col("whole")).alias("turns"), F.array_join(F.col("replies.text"), "").alias("loss_text"), "formatted_chars", "n_examples")
