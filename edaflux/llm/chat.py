"""Chat formatting by prefix-target expansion, and reading the formatted text back. DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles are escaped: each
backslash is doubled and ``<|`` becomes ``<\\|``. After the doubling a backslash between ``<`` and ``|`` can only stand
alone if the second step put it there, so both steps can be undone. A line break in a role becomes ``<\\n|``, which is
unique for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def chat_examples(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    reply_role: str = "assistant",
) -> DataFrame:
    """Rows (conversation, target, formatted, loss_start, loss_length), one for each reply of each conversation.

    ``formatted`` holds every turn up to the reply, ``target`` (from 0) is the reply's place, and the loss span
    (code points, from 0) is the reply's escaped text and nothing else. Turns behind the last reply, or a conversation
    without replies, make one more example of the whole conversation with a null ``target`` and an empty loss span, so
    that no turn is lost. Turns are ordered by turn (nulls first), then role, then text; repeated rows stay separate
    turns. Null roles and texts count as empty; rows with a null conversation form one conversation. Other columns are
    not read. A conversation is assembled in one row, as its examples are; an empty table gives an empty result.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(F.col(conversation).alias("conversation")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    written = gathered.select(
        "conversation",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
                (t["role"] == reply_role).alias("reply"),
            ),
        ).alias("turns"),
    )
    # Where each turn begins in the formatted conversation, then one row for each example.
    widths = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END) + 1))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    placed = written.select("conversation", "turns", whole.alias("whole"), widths.alias("widths"))
    last = F.element_at("turns", -1)["reply"]
    targets = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["reply"])
    asked = F.concat(targets, F.when(last, F.array().cast("array<int>")).otherwise(F.array(F.lit(-1))))
    rows = placed.select("conversation", "turns", "whole", "widths", F.explode(asked).alias("t"))
    # The span is measured on the prefix before the reply; positions in ``whole`` are prefix sums of the widths.
    before = F.aggregate(F.slice("widths", F.lit(1), F.greatest(F.col("t"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    reply = F.get("turns", F.col("t"))
    formatted = F.when(F.col("t") < 0, F.col("whole")).otherwise(F.substring("whole", F.lit(1), before + F.get("widths", F.col("t"))))
    return rows.select(
        F.col("conversation").alias(conversation), F.when(F.col("t") >= 0, F.col("t")).alias("target"),
        formatted.alias("formatted"),
        F.when(F.col("t") >= 0, before + F.length(reply["head"])).otherwise(F.lit(0)).alias("loss_start"),
        F.when(F.col("t") >= 0, F.length(reply["body"])).otherwise(F.lit(0)).alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text); escaping leaves ``<|`` to the template alone."""
    inner = F.substring(formatted, F.lit(len(START) + 1), F.length(formatted) - len(START) - len(END) - 1)
    parts = F.split(inner, r"<\|im_end\|>\n<\|im_start\|>", -1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read from its formatted examples alone.

    The longest example holds all turns. The text under the loss mask is cut from each example by its span and joined in
    the order of the replies.
    """
    masked = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    per = examples.groupBy(conversation).agg(
        F.max_by("formatted", F.length("formatted")).alias("full"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", masked.alias("text"))))).alias("replies"),
    )
    turns = per.select(
        conversation, "formatted_chars", read_back(F.col("full")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conversation, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
