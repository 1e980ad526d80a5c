"""Operator 1: preference pairs as one prompt and two masked completions.

A pair has a chosen and a rejected conversation (arrays of turns).  The longest
common prefix of turns (equal role and text) is rendered once as the prompt;
what follows in each conversation is its completion.  A mask lists the spans of
a completion that count in the loss: the text and closing mark of the
``train_role`` turns, as (start, length) in characters of the completion.

All of it is DataFrame functions on one row, so no row meets another.

* A null conversation counts as empty, a null role as ``unknown``, a null text as empty.
* Equal conversations: everything is prompt, both completions are empty, ``tied`` is true.
* One conversation a prefix of the other: its completion is empty.
* Control marks inside a text are broken up (``<|im_`` becomes ``<| im_``), so
  no text can close a turn.  Repeated pairs are rendered each; further columns
  are kept unless their name is one of the results'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def _clean(turns: Column) -> Column:
    return F.transform(F.coalesce(turns.cast(TURNS), F.array().cast(TURNS)), lambda t: F.struct(
        F.coalesce(t["role"], F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text")))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, train_role: str) -> Column:
    """Spans of trained text: the running length gives each turn's start."""
    head = lambda t: F.length(t["role"]) + F.lit(len(OPEN) + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + head(t)).alias("start"), (F.length(t["text"]) + len(CLOSE)).alias("length"))
        return F.struct((acc["at"] + F.length(_render(t))).alias("at"),
                        F.when(t["role"] == train_role, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                       train_role: str = "assistant") -> DataFrame:
    """Adds n_common, prompt, chosen_completion, rejected_completion,
    chosen_mask, rejected_mask, tied; drops the two conversations."""
    made = ["n_common", "prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask", "tied"]
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *made)]
    both = pairs.select(*kept, _clean(F.col(chosen)).alias("_c"), _clean(F.col(rejected)).alias("_r"))
    shortest = F.least(F.size("_c"), F.size("_r"))
    same = F.zip_with(F.slice("_c", F.lit(1), shortest), F.slice("_r", F.lit(1), shortest), lambda a, b: a == b)
    first_other = F.array_position(same, F.lit(False))
    n = F.when(first_other > 0, first_other - 1).otherwise(shortest).cast("int")
    cut = both.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    parts = cut.select(*kept, "n_common", F.slice("_c", F.lit(1), F.col("n_common")).alias("_p"),
                       rest("_c").alias("_c"), rest("_r").alias("_r"))
    return parts.select(
        *kept, "n_common", _text(F.col("_p")).alias("prompt"), _text(F.col("_c")).alias("chosen_completion"),
        _text(F.col("_r")).alias("rejected_completion"), _mask(F.col("_c"), train_role).alias("chosen_mask"),
        _mask(F.col("_r"), train_role).alias("rejected_mask"),
        ((F.size("_c") == 0) & (F.size("_r") == 0)).alias("tied"))


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """One pair for each conversation of (conv_id, turn, role, text): chosen is the
    whole conversation; in rejected, one assistant turn (the md5 of the id says
    which) answers with the conversation's opening text, and the turns after it
    stand as they are.  So both completions run from that turn to the end.

    A conversation without an assistant turn has two equal sides (all prompt).
    Turns sort by turn, role, text (nulls first), repeated ones are all kept; a
    conversation is one row, as long as the conversation itself.  Nothing tells
    which rows without conv_id belong together: each is a conversation of its own.
    """
    turn = F.struct("turn", "role", "text")
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    alone = turns.where("conv_id is null").select("conv_id", F.array(turn).alias("t"))
    said = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i)["role"] == "assistant")
    pick = F.conv(F.substring(F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    conv = (known.unionByName(alone).withColumn("said", said)
            .withColumn("at", F.when(F.size("said") > 0, F.get("said", (pick % F.size("said")).cast("int")))))
    simple = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    bad = F.struct(F.lit("assistant").alias("role"), F.get("t", F.lit(0))["text"].alias("text"))
    swapped = F.transform(simple, lambda x, i: F.when(i == F.col("at"), bad).otherwise(x))
    return conv.select("conv_id", simple.alias("chosen"), swapped.alias("rejected"))
