"""Chat formatting by multi-party perspective rotation (operator 8).

For every participant of a dialogue the whole dialogue is rendered with that speaker as the
assistant and all others as users with their names; the mask lists the character ranges of
the assistant's words, on which a model would be trained.

All built-in functions. A dialogue is one rendering, whatever its turns are numbered by. Only
one of more than ``most_turns`` turns, which as one array would be too large for a task, is
rendered in segments of about ``segment_turns`` turns, by equal ranges of its turn numbers;
participants are those of the whole dialogue, and offsets count from the segment.

Defined cases: rows without a conversation id are left out; a null role is a participant
named ``unknown``; a null text is empty; a null turn comes first; equal turns are ordered
by role and text, repeated rows are rendered each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MOST_TURNS, SEGMENT_TURNS = 8192, 512
UNNAMED = "unknown"


def rotate_perspectives(turns: DataFrame, most_turns: int = MOST_TURNS, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, segment, assistant, n_turns, n_trained, rendered, mask ("from:to,..." with
    character offsets) for each participant of each conversation of ``turns``
    (conv_id, turn, role, text)."""
    held = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    large = held.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).filter(F.col("n") > most_turns)
    share = (F.col("turn").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double") + 1)
    said = held.join(large, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.floor(share * F.floor(F.col("n") / segment_turns)), F.lit(0)).cast("bigint").alias("segment"),
        F.struct("turn", "role", "text").alias("m"),
    )
    who = said.select("conv_id", F.col("m.role").alias("assistant")).distinct()
    segments = said.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    speaks = lambda m: m["role"] == F.col("assistant")
    head = lambda m: F.when(speaks(m), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n")))
    tail = F.lit("<|end|>\n")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state, m):
        begin = state["at"] + F.length(head(m))
        end = begin + F.length(m["text"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + F.length(tail)).cast("bigint").alias("at"), F.when(speaks(m), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return segments.join(who, "conv_id").select(
        "conv_id",
        "segment",
        "assistant",
        F.size("ms").cast("bigint").alias("n_turns"),
        F.size(F.filter("ms", speaks)).cast("bigint").alias("n_trained"),
        F.array_join(F.transform("ms", lambda m: F.concat(head(m), m["text"], tail)), "").alias("rendered"),
        F.aggregate("ms", start, add, lambda s: F.array_join(s["spans"], ",")).alias("mask"),
    )
