"""Preference formatting of chat pairs, with DataFrame functions only.

A pair holds a chosen and a rejected conversation. Their longest common prefix of equal turns is
rendered once as the prompt; what follows in each is a completion with the spans on which loss is
taken (the assistant's text and its end mark; all else is masked).

Turns of a pair meet in one row, since a training example is one row. Texts cross one exchange.

Defined cases: rows with a null conversation id belong to no conversation and go; a null turn comes
first; equal turn numbers are ordered by role, then text; a null role or text is empty; a pair with
one side missing has an empty prompt and an empty completion there; if one side is a prefix of the
other, its completion is empty; marks that a text holds itself are broken by a blank, so that it
can't forge a turn; loss spans are code points of the completion, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def _join(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _loss(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the joined turns, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, n_chosen_turns, chosen, chosen_loss, n_rejected_turns, rejected, rejected_loss).

    turns has (conv_id, turn, role, text); pair gives a row's pair, chosen whether it's on the chosen side.
    """
    safe = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), chosen.alias("is_chosen"), F.struct(F.col("turn").alias("turn"), safe("role").alias("role"), safe("text").alias("text")).alias("t"))
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("is_chosen") == flag, F.col("t"))), _before)
    both = rows.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    equal = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differs = F.array_position(equal, False)
    cut = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(least).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    split = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _join(F.col("p")).alias("prompt"),
        F.size("c").cast("long").alias("n_chosen_turns"),
        _join(F.col("c")).alias("chosen"),
        _loss(F.col("c")).alias("chosen_loss"),
        F.size("r").cast("long").alias("n_rejected_turns"),
        _join(F.col("r")).alias("rejected"),
        _loss(F.col("r")).alias("rejected_loss"),
    )


def _before(a: Column, b: Column) -> Column:
    """Order of turns: turn (null first), role, text."""
    order = F.lit(0)
    for k in ("text", "role", "turn"):
        x, y = a[k], b[k]
        order = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(order)
    return order


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), for any 64-bit k, below zero too."""
    return format_pairs(conversations, F.shiftright(F.col("conv_id").cast("long"), 1), F.col("conv_id").cast("long").bitwiseAND(F.lit(1)) == 0)
