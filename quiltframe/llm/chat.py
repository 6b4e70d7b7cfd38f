"""Preference formatting of conversations (DataFrame operations only).

A pair of conversations, chosen and rejected, is split at the end of its longest common turn
prefix. The prefix is rendered once as the prompt; what is left of each side is rendered as a
completion with the spans that count for the loss: the words of assistant turns and their end
mark. Headers and the turns of other roles are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

TURN = "struct<role:string,text:string>"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id and ``turns``, an array of (role, text) in turn order.

    Null turn numbers come first, ties are ordered by role and text, repeated rows stay; a null
    role or text counts as empty. Rows without a conversation id belong to none and are left out.
    A conversation is one value of the result, so its turns meet in one task.
    """
    one = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return (
        turns.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("conv_id"))
        .agg(F.array_sort(F.collect_list(one)).alias("all"))
        .select("conv_id", F.expr("transform(all, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))
    )


def rendered(turns: Column) -> Column:
    """The turns as one string; no turns give an empty one."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), ""
    )


def spans(turns: Column, role: str = "assistant") -> Column:
    """Array of (start, stop) in characters of ``rendered(turns)`` that count for the loss."""
    head = lambda t: F.lit(len(BEGIN)) + F.length(t["role"]) + 1
    whole = lambda t: head(t) + F.length(t["text"]) + len(END) + 1
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        one = F.array(F.struct(start.cast("int").alias("start"), (start + F.length(t["text"]) + len(END)).cast("int").alias("stop")))
        return F.struct(
            (acc["at"] + whole(t)).cast("int").alias("at"),
            F.when(t["role"] == role, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(turns, nothing, add, lambda acc: acc["out"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common turn prefix."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds to ``pairs`` (any id columns, two arrays of turns) what training on preferences needs.

    prompt_turns, prompt, chosen_completion, rejected_completion and the unmasked spans of both
    completions (chosen_spans, rejected_spans). A null side has no turns. Where one side is a prefix of the other its
    completion is empty. The columns named are added at the end; columns of ``pairs`` with these names give way to them.
    """
    added = ["prompt_turns", "prompt", "chosen_completion", "rejected_completion", "chosen_spans", "rejected_spans"]
    (n,) = unused(pairs, "prompt_turns")
    empty = F.array().cast(f"array<{TURN}>")
    side = {k: F.coalesce(F.col(k), empty) for k in (chosen, rejected)}
    out = pairs.withColumn(n, common_turns(side[chosen], side[rejected]))
    rest = {k: F.slice(v, F.col(n) + 1, F.greatest(F.size(v), F.lit(1))) for k, v in side.items()}
    return out.select(
        *[F.col(f"`{c}`") for c in pairs.columns if c.lower() not in added],
        F.col(n).alias("prompt_turns"),
        rendered(F.slice(side[chosen], F.lit(1), F.col(n))).alias("prompt"),
        rendered(rest[chosen]).alias("chosen_completion"),
        rendered(rest[rejected]).alias("rejected_completion"),
        spans(rest[chosen]).alias("chosen_spans"),
        spans(rest[rejected]).alias("rejected_spans"),
    )


def off_topic_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs made of plain conversations: conv_id, chosen, rejected.

    chosen is the conversation. rejected is the same up to its last assistant turn, which is
    replaced by the last assistant turn of its neighbour (ids 2k and 2k+1 are neighbours) or
    left out where there is none. Conversations without an assistant turn reject nothing but
    themselves, so both completions are empty.
    """
    convs = conversations(turns, id_col).withColumn(
        "last", F.expr("aggregate(transform(turns, (t, i) -> if(t.role = 'assistant', i, -1)), -1, (a, b) -> greatest(a, b))")
    )
    replies = convs.where("last >= 0").select(
        F.expr("conv_id ^ 1").alias("conv_id"), F.expr("slice(turns, last + 1, 1)").alias("reply")
    )
    none = F.array().cast(f"array<{TURN}>")
    return convs.join(replies, "conv_id", "left").select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.when(F.col("last") < 0, F.col("turns"))
        .otherwise(F.concat(F.expr("slice(turns, 1, last)"), F.coalesce("reply", none)))
        .alias("rejected"),
    )
