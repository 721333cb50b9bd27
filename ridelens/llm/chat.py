"""Preference formatting of paired conversations with DataFrame functions only.

The turns of the chosen and the rejected conversation of a pair meet in one row.  Their longest
common prefix (equal role and text, turn by turn) is rendered once as the prompt; what
follows on each side is that side's completion, with a mask: the spans of the completion, in
characters, that assistant turns wrote and that a model is trained on.

Defined cases.  Turns go by turn number, then role and text (nulls first); repeated rows count
once.  Null role or text: rendered as the empty string, and equal to another null only.
Equal conversations: the whole is the prompt and both completions are empty.  A pair with
only one side, or a null pair number, gives no row.  Empty input: no rows.  Other columns
are ignored.  A pair's turns meet in one row, which is the unit of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rendering.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _header(t: Column) -> Column:
    return F.concat(F.lit(TURN_START), _blank(t["role"]), F.lit("\n"))


def _rendered(t: Column) -> Column:
    return F.concat(_header(t), _blank(t["text"]), F.lit(TURN_END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def trained_spans(turns: Column) -> Column:
    """``start:end`` of each assistant turn's text and end mark in ``render(turns)``, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_header(t))
        end = acc["at"] + F.length(_rendered(t))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(
            end.alias("at"),
            F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: ~(
            F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])
        ),
    )
    return F.coalesce(F.get(differs, F.lit(0)), n)


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)`` per pair.

    Both inputs have ``pair_id, turn, role, text``.  ``collect_set`` merges repeated rows
    before the one shuffle, so a conversation that many rows repeat stays small.
    """
    columns = ["pair_id", "turn", "role", "text"]
    rows = chosen.select(*columns, F.lit(True).alias("is_chosen")).unionByName(
        rejected.select(*columns, F.lit(False).alias("is_chosen"))
    )
    turn = F.struct("turn", "role", "text")
    pairs = (
        rows.filter(F.col("pair_id").isNotNull())
        .groupBy("pair_id")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("is_chosen"), turn))).alias("c"),
            F.array_sort(F.collect_set(F.when(~F.col("is_chosen"), turn))).alias("r"),
        )
        .filter((F.size("c") > 0) & (F.size("r") > 0))
        .withColumn("n", common_turns(F.col("c"), F.col("r")))
    )
    after = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("prompt_turns"),
        render(F.slice("c", 1, F.col("n"))).alias("prompt"),
        render(after("c")).alias("chosen"),
        render(after("r")).alias("rejected"),
        trained_spans(after("c")).alias("chosen_mask"),
        trained_spans(after("r")).alias("rejected_mask"),
    )
