"""Preference formatting of chat turns.

For each pair of a chosen and a rejected conversation the longest common prefix of turns (same role and text) is
rendered once, as the prompt; what follows on either side is rendered as its completion. The masks are the code point spans of prompt +
completion that are trained on: the texts of the completions' assistant turns, each with its end mark. Prompts are never trained on.

A turn is rendered as `<|role|>`, a newline, its text, `<|end|>`, a newline.

Turns of a conversation are put in order of (turn, role, text). A conversation becomes one row, so its turns must meet in
one place; nothing else does: the only exchange is by conversation, and rows stay narrow until then.

Edge cases: a null text counts as empty, a null role as `user`, a null turn comes first; null conversation ids are one conversation.
Repeated turn rows stay as repeated turns. Sides that are equal have the whole conversation as prompt, empty completions and
`differs` false; a missing side is an empty conversation. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
TRAINED = "assistant"
OUT = ["n_common", "differs", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
_TURNS = "array<struct<role:string,text:string>>"


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _ordered(turns: Column) -> Column:
    return F.transform(F.sort_array(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def gather(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and `turns`, an array of (role, text) in order."""
    return turns.groupBy(key).agg(_ordered(F.collect_list(_turn())).alias("turns"))


def pair(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, chosen and rejected from two tables of turns, by one exchange."""
    both = chosen.select(key, F.lit(True).alias("side"), _turn().alias("t")).union(rejected.select(key, F.lit(False), _turn()))
    sides = both.groupBy(key).agg(F.collect_list(F.when(F.col("side"), F.col("t"))).alias("c"), F.collect_list(F.when(~F.col("side"), F.col("t"))).alias("r"))
    return sides.select(key, _ordered(F.col("c")).alias("chosen"), _ordered(F.col("r")).alias("rejected"))


def against_cut_answers(gathered: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs each conversation, as chosen, with itself after its last assistant turn lost the later half of its words."""
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()))
    df = gathered.select(key, "turns", last.alias("last"))
    words = lambda t: F.split(t["text"], " ")
    half = lambda t: F.array_join(F.slice(words(t), 1, F.shiftright(F.size(words(t)) + 1, 1)), " ")
    cut = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), half(t)).otherwise(t["text"]).alias("text")))
    return df.select(key, F.col("turns").alias("chosen"), cut.alias("rejected"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END + "\n"))), "")


def _mask(turns: Column, start: Column) -> Column:
    """start:end of each trained turn, comma-joined, for turns rendered from code point `start` on."""

    def step(s: Column, t: Column) -> Column:
        head = s["at"] + F.length(t["role"]) + 5
        tail = head + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", head.cast("string"), tail.cast("string")))
        return F.struct((tail + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    state = F.struct(start.cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, state, step)["spans"], ",")


def format_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key with OUT for rows of key, chosen and rejected (arrays of (role, text))."""
    sides = [F.coalesce(c, F.array().cast(_TURNS)).alias(c) for c in ("chosen", "rejected")]
    df = pairs.select(key, *sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    df = df.select("*", same.alias("same"))
    first = F.array_position("same", False)
    df = df.select("*", F.when(first == 0, F.size("same")).otherwise(first - 1).cast("int").alias("n"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    df = df.select(key, "n", F.exists("same", lambda x: ~x).alias("differs"), _rendered(F.slice("chosen", 1, F.col("n"))).alias("prompt"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    start = F.length("prompt")
    return df.select(
        key,
        F.col("n").cast("long").alias("n_common"),
        "differs",
        "prompt",
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c"), start).alias("chosen_mask"),
        _mask(F.col("r"), start).alias("rejected_mask"),
    )
