"""CSV files with line ends in their values, read by many tasks.

A line starts inside a value if an odd number of quotes comes before it in its file. So quotes
are counted per block of a file, the counts are summed over the blocks before, and every task
knows how its block starts. It puts lines together to rows by itself; only rows that cross the
border of two blocks are joined afterwards.
"""

import csv
import io
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qarun.scratch import new_path, written

# Blocks whose starting states go to all tasks, some 100 bytes each: 60 TB in splits of 128 MB.
MAX_BLOCKS = 500_000

# What a piece of a block is: a whole row, the end of a row begun before, a block inside one
# row, and the start of a row that goes on in the next block.
ROW, END, MIDDLE, START = range(4)

_PIECES = "file string, at bigint, place bigint, kind int, text string"
_PIECES_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("at", pa.int64()),
        ("place", pa.int64()),
        ("kind", pa.int32()),
        ("text", pa.string()),
    ]
)


def pinned(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` now, whose reads are always split alike.

    The splits of a scan follow settings and the number of cores; here both are held.
    """
    held = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            held.conf.set(key, value)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        held.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return held


def rehomed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, which another session reads, as a frame of ``spark``."""
    none = [F.lit(None).cast(f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    empty = spark.range(1).filter(F.lit(False))  # which the optimizer takes out
    return empty.select(*none).toDF(*df.columns).union(df)


class _Block:
    """The lines of one block, put together to rows as they come."""

    def __init__(self, file: str, at: int, inside: bool):
        self.file, self.at, self.inside = file, at, inside
        self.crossing = inside  # the first row has begun in an earlier block
        self.open: list[str] = []
        self.place = 0

    def piece(self, kind: int) -> tuple:
        text = "\n".join(self.open)
        self.open = []
        if kind == ROW:
            if text in ("", "\r"):  # a wholly empty line is no row
                return ()
            self.place += 1
        return (self.file, self.at, self.place - 1, kind, text)

    def take(self, text: str, odd: bool) -> tuple:
        self.open.append(text)
        self.inside ^= odd
        if self.inside:
            return ()
        kind, self.crossing = END if self.crossing else ROW, False
        return self.piece(kind)

    def rest(self) -> tuple:
        if not self.open:
            return ()
        return self.piece(MIDDLE if self.crossing else START)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the blocks of a task; a block's lines come one after another."""
    block, out, size = None, [], 0

    def handed() -> pa.RecordBatch:
        columns = zip(_PIECES_ARROW, zip(*out, strict=True), strict=True)
        arrays = [pa.array(values, field.type) for field, values in columns]
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECES_ARROW)

    for batch in batches:
        for text, file, at, inside, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block is None or (file, at) != (block.file, block.at):
                if block is not None and (piece := block.rest()):
                    out.append(piece)
                block = _Block(file, at, inside)
            if piece := block.take(text, odd):
                out.append(piece)
            size += len(text)
            if len(out) >= 10_000 or (size > 1 << 24 and out):
                yield handed()
                out, size = [], 0
    if block is not None and (piece := block.rest()):
        out.append(piece)
    if out:
        yield handed()


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
    )


def _pieces(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    lines = _lines(pinned(spark), files)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    # One row per block of a file, the only thing that is summed up.
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        rehomed(spark, lines.groupBy("file", "at").agg(F.sum(quotes).alias("quotes")))
        .withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
        .select(
            F.col("file").alias("of_file"),
            F.col("at").alias("of_at"),
            (F.col("before") % 2 == 1).alias("inside"),
        ),
        "quote-blocks",
    )
    same = (F.col("file") == F.col("of_file")) & (F.col("at") == F.col("of_at"))
    few = starts.count() <= MAX_BLOCKS
    if not few:
        id = F.monotonically_increasing_id().alias("id")
        lines = lines.select("*", id)
    placed = rehomed(spark, lines).join(F.broadcast(starts) if few else starts, same)
    if not few:  # a join by key, and each block's lines in order again
        placed = placed.repartition("file", "at").sortWithinPartitions("file", "at", "id")
    columns = ["value", "file", "at", "inside", (quotes % 2 == 1).alias("odd")]
    pieces = placed.select(*columns).mapInArrow(_assembled, _PIECES)
    return pieces if few else written(pieces, "row-pieces")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Rows that cross blocks, each as a block of its own, between those that it crosses.

    Of a file only the pieces at the borders of its blocks meet, at most two of each.
    """
    by_place = Window.partitionBy("file").orderBy("at", "kind")
    # A block that ends one row and starts another gives END before START.
    begun = F.sum((F.col("kind") == START).cast("int")).over(by_place)
    return (
        pieces.filter(F.col("kind") != ROW)
        .withColumn("row", begun)
        .groupBy("file", "row")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("parts"),
            F.max(F.when(F.col("kind") == START, F.col("place"))).alias("before"),
            F.max("at").alias("last"),
        )
        .select(
            "file",
            # No block starts there: the next one does a byte later, or more.
            (F.get("parts", 1)["at"] - 1).alias("at"),
            ((F.get("parts", 0)["at"] == 0) & (F.col("before") < 0)).alias("header"),
            F.array_join("parts.text", "\n").alias("text"),
            (F.element_at("parts", -1)["kind"] == END).alias("ended"),
        )
    )


def named(header: str) -> list[str]:
    """The columns of a header row, as Spark names them: repeated names get their number."""
    names = next(csv.reader(io.StringIO(header.removeprefix("﻿"), newline="")))
    lower = Counter(name.lower() for name in names)
    return [
        f"_c{i}" if name == "" else f"{name}{i}" if lower[name.lower()] > 1 else name
        for i, name in enumerate(names)
    ]


def quoted_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``file, at, header, text, ended``: the rows of CSV files, by the parity of quotes.

    Rows with the same ``at`` lie together and in order, and ``at`` puts these blocks in order.
    ``ended`` is False for what is left of a file behind a quote without its partner. Every
    look at the frame gives the rows to the same tasks.
    """
    pieces = _pieces(spark, files)
    whole = pieces.filter(F.col("kind") == ROW).select(
        "file",
        "at",
        ((F.col("at") == 0) & (F.col("place") == 0)).alias("header"),
        "text",
        F.lit(True).alias("ended"),
    )
    stitched, path = _stitched(pieces), new_path(spark, "crossing-rows")
    stitched.write.parquet(path)
    crossing = rehomed(spark, pinned(spark).read.schema(stitched.schema).parquet(path))
    every = whole.unionByName(crossing)
    # The line feed is off; what is left of CR LF goes too.
    return every.withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def well_formed(rows: DataFrame, pattern: str) -> list[str]:
    """The files in which all of ``quoted_rows`` are whole rows by ``pattern``."""
    unfit = F.bool_or(~F.col("ended") | ~F.col("text").rlike(pattern))
    found = rows.groupBy("file").agg(unfit.alias("unfit")).filter(~F.col("unfit"))
    return [row.file for row in found.collect()]


def read_quoted(spark: SparkSession, rows: DataFrame, options: dict) -> DataFrame:
    """``quoted_rows`` as one table with the columns of their header, and ``_metadata``.

    ``_metadata`` has ``file_path`` and ``file_block_start``, by which rows can be numbered.
    """
    headers = rows.filter("header").select("text").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"files have different headers: {[row.text for row in headers]}")
    names = named(headers[0].text)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    place = F.struct(F.col("file").alias("file_path"), F.col("at").alias("file_block_start"))
    return (
        rows.filter(~F.col("header"))
        .select(F.from_csv("text", schema, options).alias("row"), place.alias("place"))
        .select("row.*", "place")
        .toDF(*names, "_metadata")
    )
