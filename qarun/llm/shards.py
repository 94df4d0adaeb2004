"""Sharding: contiguous shards of nearly equal size by global prefix sums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qarun.llm.common import Kept, as_text


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, row_bytes: int = 16, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Put all documents, in order of their id, into contiguous shards of near equal size.

    Gives ``doc_id, size, text_crc32, shard, slot``. ``size`` is the UTF-8 bytes of the text
    plus ``row_bytes``. A document goes to the shard in which the middle of its bytes falls
    when the total is cut at equal targets, so a shard is off its target by at most half of
    the documents at its two ends; a shard is empty if one document spans it whole. ``slot``
    counts from 0 inside a shard, in order of id.

    Null text has no bytes and the checksum of an empty one. Null ids come first. Rows with
    the same id are ordered by checksum and size, then by place in the scan; each gets a
    place of its own. An empty table gives no rows; other columns are not read.

    Rows are sorted over all tasks without their text and written with the number of their
    sorted part. Only the totals of the parts, one row each, are summed up in one place.
    """
    kept = Kept(docs.sparkSession)
    value = as_text(text)
    order = ["doc_id", "text_crc32", "size", "tie"]
    rows = kept.keep(
        docs.select(
            F.col(id).alias("doc_id"),
            (F.octet_length(value) + F.lit(row_bytes)).cast("bigint").alias("size"),
            F.crc32(value).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .orderBy(*order)
        .withColumn("part", F.spark_partition_id()),
        "sorted-sizes",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank_start"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    # One row per part of the sort, so at most spark.sql.shuffle.partitions of them.
    inside = Window.partitionBy("part").orderBy(*order)
    middle = 2 * (F.col("start") + F.sum("size").over(inside)) - F.col("size")
    placed = kept.keep(
        rows.join(F.broadcast(starts), "part")
        .withColumn("middle", middle)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast(least((middle * {shards}) div (2 * total), {shards - 1}) as int)").alias(
                "shard"
            ),
            (F.col("rank_start") + F.row_number().over(inside) - 1).alias("rank"),
        ),
        "placed",
    )
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
