"""Preference formatting of conversations, in DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is
rendered once as the prompt; the turns after it are rendered as two completions. Each completion has a mask:
the spans, in code points, that a model is trained on (what an assistant says, with its end mark).

Turns of a conversation are ordered by turn (null last), then role, then text. A conversation is one training
example and is built in one row, as a document is; pairs are joined by id, one row each, so no pair meets
another. Cases: a null role or text is empty; rows without id take no part; a pair that lacks one side gets an
empty conversation there; equal conversations are all prompt and have empty completions; repeated rows are
turns of their own; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden

TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its ordered `turns`."""
    one = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(ordered.alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns in the longest common prefix."""
    both = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), both), lambda i: (F.element_at(a, i)["role"] != F.element_at(b, i)["role"]) | (F.element_at(a, i)["text"] != F.element_at(b, i)["text"]))
    return F.when(both == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, both))


def _tail(turns: Column, skip: Column) -> Column:
    return F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0)))


def mask(turns: Column) -> Column:
    """Spans of the rendered turns that are trained on: array of (start, end), end exclusive."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(rendered(x))
        begin = acc["at"] + F.length(x["role"]) + F.lit(len("<||>\n"))
        one = F.array(F.struct(begin.alias("start"), (stop - 1).alias("end")))
        return F.struct(stop.alias("at"), F.when(x["role"] == TRAINED_ROLE, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """From arrays of turns to n_prompt_turns, prompt, and text and mask of each completion; other columns stay, but for those with the name of a result column."""
    empty = F.array().cast(TURNS)
    at = hidden(pairs)
    left, right = f"{at}chosen", f"{at}rejected"
    out = pairs.withColumns({left: F.coalesce(chosen, empty), right: F.coalesce(rejected, empty)}).drop(chosen, rejected)
    out = out.withColumn("n_prompt_turns", common_turns(F.col(left), F.col(right)))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")
    out = out.withColumn("prompt", text(F.slice(left, F.lit(1), F.col("n_prompt_turns"))))
    for name, side in ((chosen, left), (rejected, right)):
        rest = _tail(F.col(side), F.col("n_prompt_turns"))
        out = out.withColumns({name: text(rest), f"{name}_mask": mask(rest)})
    return out.drop(left, right)


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs the conversations of two tables of turns by id and formats them."""
    sides = [conversations(t, key).withColumnRenamed("turns", name) for t, name in ((chosen, "chosen"), (rejected, "rejected"))]
    return format_pairs(sides[0].join(sides[1], key, "full"))


def with_foreign_reply(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs for a table without preferences: chosen is each conversation as it is, rejected the same with the last
    reply of its neighbour (id with the lowest bit turned) in the place of its own; empty, if there is no such
    reply. A conversation without a reply is compared with itself."""
    own = conversations(turns, key)
    at = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED_ROLE)), F.lit(0))
    own = own.withColumn("at", at)
    reply = own.where("at > 0").select(F.col(key).bitwiseXOR(F.lit(1)).alias(key), F.element_at("turns", F.col("at"))["text"].alias("reply"))
    swapped = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == F.col("at"), F.coalesce("reply", F.lit(""))).otherwise(x["text"]).alias("text")))
    return own.join(reply, key, "left").select(key, F.col("turns").alias("chosen"), swapped.alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
