"""Multi-party perspective rotation: each dialogue once for every participant, who is the assistant there.

A rendered turn is `<|role|> name`, a line break, the text, `<|end|>` and a line break. The participant
whose perspective it is speaks as assistant, without a name; the others are named users; system turns
stay system turns for all. Turns stay rows, with their place in the rendered dialogue, so a dialogue of
any length is spread over tasks: places are summed within blocks of turns and then over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
END = "<|end|>"


def _header(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>"), F.when(role == "user", F.concat(F.lit(" "), name)).otherwise(F.lit("")), F.lit("\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """A row per dialogue, perspective and turn: conv, perspective, turn, role, rendered, start, end, mask_start, mask_end.

    start and end are the turn's code points in the rendered dialogue; mask_start to mask_end is what is
    trained on there, the assistant's text and its end mark, null in other turns. Dialogues without
    a participant but the system give no rows. A null speaker is a user named `unknown` and has no
    perspective; a null text is empty; null turns come last; equal turns go by speaker and text.
    Rows with a null dialogue id are one dialogue.
    """
    kept = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    people = kept.filter(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    each = kept.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    lines = each.withColumn("role", role).withColumn("header", _header(F.col("role"), F.coalesce("speaker", F.lit("unknown")))).withColumn("rendered", F.concat("header", "text", F.lit(f"{END}\n")))
    sized = lines.withColumn("size", F.char_length("rendered").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit((1 << 62))))

    by = ["conv", "perspective"]
    order = [F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), F.xxhash64("text"), "text"]
    within = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = sized.groupBy(*by, "block").agg(F.sum("size").alias("whole")).select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("whole").over(ahead), zero).alias("before"))
    here = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), zero))
    placed = here.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))).withColumn("start", F.col("before") + F.col("inside"))
    mask = F.when(F.col("role") == "assistant", F.col("start") + F.char_length("header"))
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "role", "rendered", "start", (F.col("start") + F.col("size")).alias("end"),
        mask.alias("mask_start"), (mask + F.char_length("text") + len(END)).alias("mask_end"))
