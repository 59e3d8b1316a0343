"""Chat formatting: rotate a multi-party dialogue so that each participant is the assistant once. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a block of the two-level running sum.
BLOCK = 256


def rotate_perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrator: str = "system") -> DataFrame:
    """One row per conversation, participant and turn: how that turn is rendered with the participant as assistant.

    Participants are the distinct speakers of a conversation except the narrator, whose turns are system messages in
    every perspective. The participant's turns become assistant messages, all others user messages that carry the
    speaker's name. Concatenating `segment` by `position` gives the whole dialogue; char_start and char_end place the
    segment in it, and mask_start to mask_end is what the loss is taken over (the assistant's words and end mark; null
    elsewhere). No conversation is gathered into one row or task: running lengths are summed in blocks of turns, then
    over blocks.

    Turns are ordered by turn, speaker, text, nulls first; equal rows are all rendered, one after another. A null text
    is empty, a null speaker is named `unknown`, a null conversation is one conversation. A conversation with only
    narrator turns has no participant and gives no row. Other columns are not read; an empty table gives no row.
    """
    t = df.select(
        df[conv].alias("conv_id"), df[turn].cast("long").alias("turn"), F.coalesce(df[speaker], F.lit("unknown")).alias("speaker"), F.coalesce(df[text], F.lit("")).alias("text")
    )
    who = t.filter(F.col("speaker") != narrator).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("participant")).distinct()
    r = t.join(who, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    mine = F.col("speaker") == F.col("participant")
    as_role = F.when(F.col("speaker") == narrator, "system").when(mine, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), as_role, F.when((F.col("speaker") != narrator) & ~mine, F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("|>\n"))
    r = r.select(
        "conv_id", "participant", "turn", "speaker", as_role.alias("rendered_role"), mine.alias("target"), F.char_length(head).cast("long").alias("_head"),
        F.concat(head, F.col("text"), F.lit("<|end|>\n")).alias("segment"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("_block"), "text",
    ).withColumn("_n", F.char_length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "participant", "_block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "participant").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        r.groupBy("conv_id", "participant", "_block").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .select(F.col("conv_id").alias("_c"), F.col("participant").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_pos"))
    )
    r = r.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).withColumn("_at", F.count(F.lit(1)).over(inside))
    r = r.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("participant") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    start = F.col("_off") + F.col("_in")
    return r.select(
        "conv_id", "participant", (F.col("_pos") + F.col("_at")).cast("long").alias("position"), "turn", "speaker", "rendered_role", "segment",
        start.cast("long").alias("char_start"), (start + F.col("_n")).cast("long").alias("char_end"),
        F.when(F.col("target"), start + F.col("_head")).cast("long").alias("mask_start"),
        F.when(F.col("target"), start + F.col("_n") - 1).cast("long").alias("mask_end"),
    )
