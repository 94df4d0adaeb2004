"""Time gaps between the records of a run."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qarun.scratch import written

# 2**17 = 131,072 slots share a block, so a window over one stays in memory (some 15 MB).
BLOCK_BITS = 17
# Blocks share a span, and spans an era, by 2**12; a run has few eras at any threshold.
SPAN_BITS = 12


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _ends_before(ends: DataFrame, run: str, levels: int) -> DataFrame:
    """Add ``_before``: the ``_last`` of the block before in the same run.

    Looked up among the blocks of a span, and across spans by the same rule for spans.
    """
    if levels == 0:
        blocks = Window.partitionBy(run).orderBy("_block")
        return ends.withColumn("_before", F.lag("_last").over(blocks))
    ends = ends.withColumn("_span", F.shiftright("_block", SPAN_BITS))
    spans = ends.groupBy(run, "_span").agg(F.max("_last").alias("_last"))
    outer = _ends_before(spans.withColumnRenamed("_span", "_block"), run, levels - 1).select(
        F.col(run).alias("_of_run"),
        F.col("_block").alias("_of_span"),
        F.col("_before").alias("_outer"),
    )
    in_span = Window.partitionBy(run, "_span").orderBy("_block")
    same = F.col(run).eqNullSafe(F.col("_of_run")) & (F.col("_span") == F.col("_of_span"))
    return (
        ends.withColumn("_inner", F.lag("_last").over(in_span))
        .join(outer, same)
        .select(run, "_block", F.coalesce("_inner", "_outer").alias("_before"))
    )


def gaps(
    log: DataFrame, run: str, threshold: timedelta, ts: str = "ts", order: str = "row_index"
) -> DataFrame:
    """Records that came more than ``threshold`` after the one before them in their run.

    Gives ``run, order, prev_ts, ts, gap_micros``; records with equal ``ts`` are taken
    in the order of ``order``, and records without ``ts`` are left out.

    Two records in one slot of ``threshold`` length are never further apart than the
    threshold. So a slot is folded into its first and last record before any shuffle,
    and only slots, which are written once, are put in order. A run with many slots is
    worked on in blocks, and the block before is looked up by spans, so no window holds a run.
    """
    if threshold < timedelta(0):
        raise ValueError("threshold must not be negative")
    limit = threshold // timedelta(microseconds=1)
    width = max(limit, 1)

    slot = F.expr("(_micros - pmod(_micros, _width)) div _width").alias("_slot")
    slots = written(
        log.filter(F.col(ts).isNotNull())
        .withColumns({"_micros": _micros(ts), "_width": F.lit(width)})
        .select(slot, run, ts, order)
        # The slot comes first: it tells rows apart faster than a run that most share.
        .groupBy("_slot", run)
        .agg(F.min(F.struct(ts, order)).alias("_first"), F.max(ts).alias("_last"))
        .withColumn("_block", F.shiftright("_slot", BLOCK_BITS)),
        "gap-slots",
    )

    # Each block is lent the end of the block before it, as a row ahead of its slots.
    ends = slots.groupBy("_block", run).agg(F.max("_last").alias("_last"))
    lent = _ends_before(ends, run, 2).select("_block", run, F.col("_before").alias("_last"))
    lent = lent.filter(F.col("_last").isNotNull())

    in_block = Window.partitionBy("_block", run).orderBy(F.col("_slot").asc_nulls_first())
    return (
        slots.unionByName(lent, allowMissingColumns=True)
        .withColumn("prev_ts", F.lag("_last").over(in_block))
        .filter(F.col("_slot").isNotNull())
        .select(run, f"_first.{order}", "prev_ts", f"_first.{ts}")
        .withColumn("gap_micros", _micros(ts) - _micros("prev_ts"))
        .filter(F.col("gap_micros") > limit)
    )


def stalled(
    log: DataFrame,
    run: str,
    threshold: timedelta,
    now: datetime | Column,
    ts: str = "ts",
    order: str = "row_index",
) -> DataFrame:
    """Runs whose last record is more than ``threshold`` before ``now``: stuck, or ended.

    Gives ``run, order, ts, gap_micros`` of the last record; ``gaps`` reports a stall only once
    the next record is there. Of records with the same ``ts`` the last by ``order`` counts, and
    those without ``ts`` are left out. A run is folded to one row in each part before the shuffle.
    """
    if threshold < timedelta(0):
        raise ValueError("threshold must not be negative")
    until = now if isinstance(now, Column) else F.lit(now)
    last = F.max(F.struct(ts, order)).alias("_last")
    gap = F.unix_micros(until.cast("timestamp")) - _micros(ts)
    return (
        log.filter(F.col(ts).isNotNull())
        .groupBy(run)
        .agg(last)
        .select(run, f"_last.{order}", f"_last.{ts}")
        .withColumn("gap_micros", gap)
        .filter(F.col("gap_micros") > threshold // timedelta(microseconds=1))
    )
