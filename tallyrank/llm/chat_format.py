"""Prefix-target expansion of conversations into training examples.

Template, one block per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside roles and texts are escaped reversibly: wherever ``<``,
any number of backslashes and ``|`` follow each other, one more backslash is
put before the ``|``. An escaped string therefore never holds ``<|``, so the
markers can be found by plain search; taking one backslash away restores the
text. A newline inside a role becomes the marker ``<|nl|>``.

Only built-in expressions are used. A conversation is gathered into one row
because its formatted text *is* one string; conversations are bounded by what
a training example can hold, and no other grouping happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import prefix_sums

START, END, ROLE_NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def format_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per training example: ``(conv, example, is_last, n_turns, formatted,
    loss_start, loss_end)``.

    Every turn whose role is ``target`` becomes an example: all turns before it
    as context, then itself; the half-open range of code points ``[loss_start,
    loss_end)`` of ``formatted`` covers its (escaped) text and nothing else.
    ``example`` numbers a conversation's examples from 0. Turns after the last
    target, if any, come as one more row without a loss range (both null), so
    the row with ``is_last`` holds the whole conversation.

    Turns are ordered by number, null first, ties by role and text; a repeated
    row is a turn of its own. A null role or text counts as empty, a null
    conversation id is an id like any other, other columns are ignored, an
    empty table gives no rows.
    """
    t = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    block = t.select(
        "conv", F.struct(
            "t.turn", "t.role", "t.text",
            F.concat(F.lit(START), F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit(ROLE_NEWLINE)),
                     F.lit("\n")).alias("head"),
            escape(F.col("t.text")).alias("body")).alias("b"))
    convs = (block.groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("bs"))
             .select("conv", F.col("bs"), F.size("bs").alias("n"),
                     F.transform("bs", lambda b: F.struct(
                         (b["role"] == target).alias("is_target"),
                         F.length(b["head"]).alias("head"), F.length(b["body"]).alias("body"))).alias("sizes"),
                     F.array_join(F.transform("bs", lambda b: F.concat(b["head"], b["body"], F.lit(END + "\n"))),
                                  "").alias("full")))
    tail = len(END) + 1
    ends = convs.select("conv", "full", "n", "sizes", F.transform(
        "sizes", lambda s: s["head"] + s["body"] + tail).alias("lengths"))
    ends = ends.select("conv", "full", "n", "sizes", prefix_sums(F.col("lengths")).alias("ends"))
    turn_ends = F.zip_with("sizes", "ends", lambda s, at: F.struct(
        at.alias("at"), s["is_target"].alias("is_target"),
        F.when(s["is_target"], at - tail - s["body"]).alias("lo"), F.when(s["is_target"], at - tail).alias("hi")))
    numbered = F.transform(turn_ends, lambda e, i: F.struct(
        e["at"].alias("at"), (i + 1).alias("n"), e["is_target"].alias("is_target"),
        e["lo"].alias("lo"), e["hi"].alias("hi")))
    ends = ends.select("conv", "full", "n", F.filter(
        numbered, lambda e: e["is_target"] | (e["n"] == F.col("n"))).alias("ex"))
    return (ends.select("conv", "full", "n", F.posexplode("ex").alias("example", "e"))
            .select(F.col("conv").alias(conv), "example", (F.col("e.n") == F.col("n")).alias("is_last"),
                    F.col("e.n").alias("n_turns"), F.substring(F.col("full"), F.lit(1), F.col("e.at")).alias("formatted"),
                    F.col("e.lo").alias("loss_start"), F.col("e.hi").alias("loss_end")))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted example, unescaped."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(blocks, 1, F.size(blocks) - 1)
    return F.transform(turns, lambda b: F.struct(
        unescape(F.replace(F.substring(F.substring_index(b, "\n", 1), len(START) + 1, 1 << 30),
                           F.lit(ROLE_NEWLINE), F.lit("\n"))).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(1 << 30))).alias("text")))


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the examples alone: number and digest
    of all turns, number of characters and digest of the text under the loss
    ranges, and the characters of all formatted examples together."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    parts = examples.select(
        conv, "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"),
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"))
    g = parts.groupBy(conv).agg(
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"))
    g = g.select(conv, "formatted_chars", "loss", read_back(F.col("whole")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        conv, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars")
