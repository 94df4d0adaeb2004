"""Recorded answers: a user turn with the assistant turn right after it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qarun.functions import ORDER_BUCKET_BITS, long_bucket
from qarun.schema import ASK, ERROR, OK
from qarun.scratch import written

BLOCK = ["conv_id", "block"]


def _lent_turns(turns: DataFrame, bits: int) -> DataFrame | None:
    """The first turn of each later block, moved to the block before it.

    None if no conversation has a second block, which row-group statistics tell
    without a read. Otherwise the keys of first turns, one per block, are written and put
    in order, and their rows are picked from a second scan.
    """
    later = turns.filter(F.col("turn") >= 1 << bits)
    if later.isEmpty():
        return None
    firsts = written(
        later.groupBy(*BLOCK)
        .agg(F.min("turn").alias("turn"))
        .withColumn("_span", long_bucket(F.col("block"), bits)),
        "first-turns",
    )
    # The block before is looked up in a span of 2**bits blocks, and across spans by
    # their last blocks, so turn numbers far apart do not lead to one large window.
    by_span = Window.partitionBy("conv_id").orderBy("_span")
    in_span = Window.partitionBy("conv_id", "_span").orderBy("block")
    ends = (
        firsts.groupBy("conv_id", "_span")
        .agg(F.max("block").alias("_end"))
        .select("conv_id", "_span", F.lag("_end", 1, 0).over(by_span).alias("_before"))
    )
    before = F.coalesce(F.lag("block").over(in_span), F.col("_before"))
    targets = firsts.join(ends, ["conv_id", "_span"]).select(
        "conv_id", "turn", before.alias("_to")
    )
    return (
        later.join(targets, ["conv_id", "turn"])
        .withColumn("block", F.col("_to"))
        .withColumn("_lent", F.lit(True))
        .drop("_to")
    )


def pair_turns(
    conversations: DataFrame, keep_block: bool = False, bits: int = ORDER_BUCKET_BITS
) -> DataFrame:
    """One row per user turn: ``conv_id, turn, status, phase, question, response``.

    ``conv_id, turn`` is the key of ``conversations``. A question is ``ok`` when the
    next turn of its conversation is by the assistant. A long conversation is worked
    on in blocks of 2**bits turns, so no task holds a whole one. ``keep_block``
    keeps the column ``block``; by it and ``conv_id`` the rows are partitioned.
    """
    # The text of other roles, such as system prompts, is never part of the result.
    needed = F.when(F.col("role").isin("user", "assistant"), F.col("text"))
    turns = conversations.select(
        "conv_id",
        "turn",
        "role",
        needed.alias("text"),
        F.greatest(long_bucket(F.col("turn"), bits), F.lit(0)).alias("block"),
    )
    lent = _lent_turns(turns, bits)
    turns = turns.withColumn("_lent", F.lit(False))
    here = Window.partitionBy(*BLOCK).orderBy("turn")
    paired = (
        (turns if lent is None else turns.unionByName(lent))
        .select(
            "*", F.lead("role").over(here).alias("_by"), F.lead("text").over(here).alias("_reply")
        )
        .filter((F.col("role") == "user") & ~F.col("_lent"))
    )

    answered = F.col("_by").eqNullSafe(F.lit("assistant"))
    pairs = paired.select(
        "conv_id",
        "turn",
        F.when(answered, OK).otherwise(ERROR).alias("status"),
        F.lit(ASK).alias("phase"),
        F.col("text").alias("question"),
        F.when(answered, F.col("_reply")).alias("response"),
        "block",
    )
    return pairs if keep_block else pairs.drop("block")
