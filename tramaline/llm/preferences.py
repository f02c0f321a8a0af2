"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns is rendered once, as the prompt. What follows it in each conversation is
that conversation's completion, with a mask of the characters that count in training: those of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and turns: an array of (role, text) in order of turn, one row per conversation.

    Null roles and texts count as empty. Turns with one number go by role and text. A conversation is the unit
    here: its turns meet in one row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: str, b: str) -> F.Column:
    """Number of leading turns that both arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(differs == 0, longest).otherwise(differs - 1).cast("long")


def render(turns: F.Column) -> F.Column:
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return F.array_join(one, "")


def mask(turns: F.Column) -> F.Column:
    """start:end (code points of the completion, end exclusive) of each assistant turn's text and close, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: F.Column, t: F.Column) -> F.Column:
        text = s["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = text + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws(":", text.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def format_preferences(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair: key, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask.

    pairs has key, chosen and rejected (arrays of role and text, as from conversations()). Equal conversations
    share all turns and have empty completions; a null array counts as empty.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    p = p.withColumn("n_prefix", common_prefix("c", "r"))
    rest = lambda x: F.slice(x, (F.col("n_prefix") + 1).cast("int"), F.greatest(F.size(x), F.lit(1)))
    return p.select(
        key, "n_prefix", render(F.slice("c", F.lit(1), F.col("n_prefix").cast("int"))).alias("prompt"),
        render(rest("c")).alias("chosen"), mask(rest("c")).alias("chosen_mask"), render(rest("r")).alias("rejected"), mask(rest("r")).alias("rejected_mask"),
    )


def paired_with_neighbour(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation as chosen; as rejected, the same with its last turn's text taken from its partner's last turn.

    Partners are conversations 2k and 2k + 1. Without a partner, the rejected conversation lacks its last turn.
    A null key has no partner.
    """
    last = convs.select(F.col(key).bitwiseXOR(F.lit(1).cast("long")).alias("_partner"), F.element_at("turns", -1)["text"].alias("_text"))
    turn = F.element_at("turns", -1)
    swapped = F.when(F.col("_text").isNotNull(), F.array(F.struct(turn["role"].alias("role"), F.col("_text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    both = convs.join(last, convs[key] == last["_partner"], "left")
    return both.select(F.col(key).alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), swapped).alias("rejected"))
