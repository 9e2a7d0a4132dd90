"""Multi-party perspective rotation of dialogues.

For every participant, the dialogue is rendered with that speaker as the assistant and all others as named users, and the
assistant's own spans are given as a loss mask. System turns belong to no participant. Dialogues are cut into blocks of
``block`` turn numbers, so that no row grows with a dialogue of any length; most have one block. A block says at which
character of the whole rendering it starts, so that the blocks of a dialogue, in order, are the dialogue, and start plus
span is the place of a span in it. Starts come from the lengths of blocks alone; a rendering is never held whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perspectives(turns: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, participant, block, start, n_turns, rendered, mask: a row for each participant and block of a conversation.

    ``turns``: conv_id, turn, role, text. A turn is ``<|im_start|>name\\ntext<|im_end|>\\n``. mask lists the character
    spans ``from-to`` (to exclusive, end mark included) that the participant says, comma-joined; empty where it is silent
    in the block. A null text counts as empty, a null role as "unknown"; rows with a null conv_id or turn are left out, as
    they have no place in a dialogue. Turns of equal number follow in the order of role and text, in one block; repeated rows
    stay. Texts of any length stay whole. An empty table gives an empty one; other columns are ignored, whatever their names.
    """
    rows = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("participant")).distinct()
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def head(t):
        name = F.when(t["role"] == F.col("participant"), F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))

    def step(acc, t):
        start = acc["at"] + F.length(head(t))
        end = start + F.length(t["text"]) + len("<|im_end|>")
        span = F.when(t["role"] == F.col("participant"), F.array(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    # A block's length for a participant: that with everyone named, less the names that become "assistant" in it.
    named, own = len("user name="), len("assistant")
    frame = len("<|im_start|>") + len("\n<|im_end|>\n")
    whole = F.sum(F.length("text") + frame + F.when(F.col("role") == "system", len("system")).otherwise(named + F.length("role"))).alias("whole")
    cells = rows.groupBy("conv_id", F.floor(F.col("turn") / block).alias("block")).agg(whole)
    mine = rows.where("role <> 'system'").groupBy("conv_id", F.floor(F.col("turn") / block).alias("block"), F.col("role").alias("participant")).agg(F.sum(own - named - F.length("role")).alias("less"))
    sizes = cells.join(speakers, "conv_id").join(mine, ["conv_id", "block", "participant"], "left").withColumn("size", F.col("whole") + F.coalesce("less", F.lit(0)))
    past = F.sum("size").over(Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv_id", "participant", "block", F.coalesce(past, F.lit(0)).cast("long").alias("start"))
    joined = blocks.join(starts, ["conv_id", "block"])
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit("<|im_end|>\n"))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return joined.select(
        "conv_id", "participant", "block", "start", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"),
        F.array_join(F.aggregate("turns", zero, step, lambda a: a["spans"]), ",").alias("mask"),
    )
