"""Zero-based row index without a sort of all rows in one task.

Rows are counted per bucket, the counts are summed up in bucket order, and each
row adds its place in its bucket to the start of that bucket. Only the counts,
never the rows, are sorted across buckets.
"""

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from qarun.functions import ORDER_BUCKET_BITS
from qarun.scratch import written


def _mark(df: DataFrame) -> str:
    """A start for names of helper columns that no column of ``df`` has."""
    mark = "_"
    while any(name.lower().startswith(mark) for name in df.columns):
        mark += "_"
    return mark


def _join_start(
    rows: DataFrame, counts: DataFrame, keys: Sequence[str], mark: str, how: str = "inner"
) -> DataFrame:
    """Give each row the ``start`` of its bucket: the sum of ``n`` over smaller keys.

    ``counts`` has one row per bucket. It is sorted once and written with the number
    of the sorted part, so that every later read agrees; then the parts are summed side
    by side. Names of helper columns begin with ``mark``.
    """
    parts = written(
        counts.orderBy(*keys).withColumn(f"{mark}part", F.spark_partition_id()), "bucket-counts"
    )
    # One row per part of the sort, at most spark.sql.shuffle.partitions of them.
    any_null = reduce(or_, [F.col(key).isNull() for key in keys])
    totals = parts.groupBy(f"{mark}part").agg(F.sum(f"{mark}n"), F.max(any_null)).collect()
    numbers, sizes, nulls = zip(*sorted(totals), strict=True) if totals else [()] * 3
    bases = rows.sparkSession.createDataFrame(
        pa.table(
            {
                f"{mark}part": pa.array(numbers, pa.int32()),
                f"{mark}base": pa.array([0, *accumulate(sizes)][: len(sizes)], pa.int64()),
            }
        )
    )

    by_key = Window.partitionBy(f"{mark}part").orderBy(*keys)
    earlier = F.sum(f"{mark}n").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    inner = {key: f"{mark}at{i}" for i, key in enumerate(keys)}
    starts = (
        parts.join(F.broadcast(bases), f"{mark}part")
        .withColumn(f"{mark}start", F.col(f"{mark}base") + F.coalesce(earlier, F.lit(0)))
        .drop(f"{mark}part", f"{mark}base", f"{mark}n")
        .withColumnsRenamed(inner)
    )
    # A null-safe join does not keep the partitioning of the rows, so it is used only
    # when there is a null to be matched.
    same = [
        F.col(key).eqNullSafe(F.col(at)) if any(nulls) else F.col(key) == F.col(at)
        for key, at in inner.items()
    ]
    return rows.join(starts, reduce(and_, same), how).drop(*inner.values())


def _by_key(df: DataFrame, order: Sequence[str], bucket: Sequence[str], mark: str) -> DataFrame:
    counts = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias(f"{mark}n"))
    inside = [name for name in order if name not in bucket] or order
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(*inside)) - 1
    return (
        _join_start(df.withColumn(f"{mark}place", place), counts, bucket, mark)
        .withColumn("row_index", F.col(f"{mark}start") + F.col(f"{mark}place"))
        .drop(f"{mark}place", f"{mark}start")
    )


def _by_file(df: DataFrame) -> DataFrame:
    """Rows by file and place: counts of blocks from one narrow scan, the rows from a second.

    The place of a row in its block is its distance from the block's first row in the first
    scan. If the second scan is split in another way, some row falls outside of its block, and
    the job ends with an error instead of wrong numbers.
    """
    mark = _mark(df)
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Else the splits of the second scan would follow the cores there are by then.
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    block = [f"{mark}path", f"{mark}offset"]
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias(block[0]),
        F.col("_metadata.file_block_start").alias(block[1]),
        F.monotonically_increasing_id().alias(f"{mark}id"),
    )
    n, first, last = F.count(F.lit(1)), F.min(f"{mark}id"), F.max(f"{mark}id")
    moved = F.raise_error(F.lit("rows of a file block are not together; index the scan itself"))
    counts = rows.groupBy(*block).agg(
        n.alias(f"{mark}n"),
        n.alias(f"{mark}size"),
        F.when(last - first + 1 == n, first).otherwise(moved).alias(f"{mark}first"),
    )
    place = F.col(f"{mark}id") - F.col(f"{mark}first")
    other = F.raise_error(
        F.lit("files were split in another way than for counting; keep spark.sql.files settings")
    )
    inside = (place >= 0) & (place < F.col(f"{mark}size"))
    return (
        _join_start(rows, counts, block, mark, "left")
        .withColumn("row_index", F.when(inside, F.col(f"{mark}start") + place).otherwise(other))
        .drop(*block, *[f"{mark}{name}" for name in ("id", "first", "start", "size")], "_metadata")
    )


# A hot range of numbers is cut to some 2**8 parts, and a prefix gets four more letters.
STEP_BITS, STEP_LETTERS = 8, 4


def _measure(name: str, kind: T.DataType) -> Column | None:
    """A whole number or text that never falls as the column grows; null where it is null."""
    column = F.col(name)
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return column.cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(column.cast("date")) * 1440 + F.hour(column) * 60 + F.minute(column)
        seconds = F.extract(F.lit("SECOND"), column) * 1_000_000
        return minutes.cast("bigint") * 60_000_000 + seconds.cast("bigint")
    if isinstance(kind, T.FractionalType):
        # The logarithm grows with the number; NaN comes last.
        number = column.cast("double")
        size = F.signum(number) * F.log1p(F.abs(number))
        size = F.when(F.isnan(number), F.lit(float("inf"))).otherwise(size)
        return F.floor(size * float(1 << 50))
    if isinstance(kind, T.StringType):
        return column  # texts are in the order of their code points
    return None


def _shared_letters(a: Column, b: Column) -> Column:
    """Length of the prefix that two texts share."""
    reach = F.sequence(F.lit(0), F.least(F.char_length(a), F.char_length(b)))
    same = F.filter(reach, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.array_max(same)


def _bucketed(df: DataFrame, order: Sequence[str], limit: int, mark: str) -> DataFrame:
    """Add ``bucket``: one key for neighbouring rows, that sorts like ``order``.

    All rows start in one bucket. A bucket with more than ``limit`` rows is cut by the first
    order column that differs in it: numbers to ranges, as wide as its least and greatest need,
    and texts by the letters behind their shared prefix. So only hot buckets are cut, and their
    number follows the number of rows, not of values. Rows with the same order columns stay together.
    """
    measures = {name: _measure(name, df.schema[name].dataType) for name in order}
    texts = {name for name in order if isinstance(df.schema[name].dataType, T.StringType)}
    columns = {f"{mark}m{i}": measures[name] for i, name in enumerate(order)}
    key, n = f"{mark}key", f"{mark}n"
    hot: list[DataFrame] = []

    def keyed(rows: DataFrame) -> DataFrame:
        """The bucket of each row: one piece per level, null from where it was not hot."""
        pieces = [F.lit(0).alias("p")]
        rows = rows.withColumn(key, F.struct(*pieces))
        for level, cuts in enumerate(hot):
            rows = rows.join(cuts.withColumnRenamed(key, f"{mark}of"), F.col(key) == F.col(f"{mark}of"), "left")
            number, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
            for i, name in enumerate(order):
                mine, m = F.col(f"{mark}step") == i, F.col(f"{mark}m{i}")
                if name in texts:
                    text = F.when(mine, F.substring(m, F.lit(1), F.col(f"{mark}cut"))).otherwise(text)
                else:
                    part = F.call_function("shiftright", m, F.col(f"{mark}cut"))
                    number = F.when(mine, part).otherwise(number)
            own = [F.col(key)[field] for field in _fields(level)]
            named = [value.alias(field) for value, field in zip(own, _fields(level), strict=True)]
            more = [number.alias(f"n{level}"), text.alias(f"t{level}")]
            rows = rows.withColumn(key, F.struct(*named, *more)).drop(
                f"{mark}of", f"{mark}step", f"{mark}cut"
            )
        return rows

    while True:
        narrow = keyed(df.select(*order, *[m.alias(name) for name, m in columns.items()]))
        step, cut = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(order))):
            m = f"{mark}m{i}"
            low, high = F.min(m), F.max(m)
            if name in texts:
                width = _shared_letters(low, high) + STEP_LETTERS
                apart = low != high
            else:
                span = F.log2(high.cast("double") - low.cast("double") + 1)
                width = F.greatest(F.ceil(span).cast("int") - STEP_BITS, F.lit(0))
                apart = low != high
            some_null = (F.count(m) > 0) & (F.count(m) < F.count(F.lit(1)))
            # Where a measure cannot tell values apart, the bucket stays as it is.
            alike = F.coalesce(F.min(name) == F.max(name), F.lit(True))
            splits = F.coalesce(apart, F.lit(False)) | some_null
            step = F.when(splits, F.lit(i)).when(alike, step)
            cut = F.when(splits, width).when(alike, cut)
        counts = narrow.groupBy(key).agg(
            F.count(F.lit(1)).alias(n), step.alias(f"{mark}step"), cut.alias(f"{mark}cut")
        )
        full = counts.filter((F.col(n) > limit) & F.col(f"{mark}step").isNotNull()).drop(n)
        cuts = written(full, "hot-buckets")
        if cuts.isEmpty():
            break
        hot.append(cuts)
    rows = keyed(df.withColumns(columns))
    return rows.withColumnRenamed(key, f"{mark}bucket").drop(*columns)


def _fields(level: int) -> list[str]:
    """The pieces of a key after so many cuts."""
    return ["p", *[f"{kind}{i}" for i in range(level) for kind in "nt"]]


def with_row_index(
    df: DataFrame,
    order: str | Sequence[str] | None = None,
    bucket: Sequence[str] | None = None,
    bits: int = ORDER_BUCKET_BITS,
) -> DataFrame:
    """Add ``row_index``, the zero-based position of each row.

    Without ``order``, ``df`` must come straight from a file scan: rows are numbered by
    file path, then by place in the file. It is read twice, first without its columns, and
    not copied; both scans have to be split alike, so ``spark.sql.files.minPartitionNum`` is set
    for the session if it is not yet, and the ``spark.sql.files`` settings must stay as they
    are until the rows are read (``read_questions`` holds them for files of several kinds).

    With ``order``, columns that together identify a row, they are numbered in its ascending
    order, nulls first. Neighbouring rows share a bucket: a range of numbers or times, a
    prefix of texts, or a range of the logarithm of fractions. A bucket with more than 2**bits
    rows is cut again, so there are about as many buckets as the rows fill, whatever the
    number of distinct values, and a hot value is spread over many.

    ``bucket`` may name columns that group neighbouring rows and sort like ``order``;
    a frame already partitioned by them is not shuffled again.

    ``df`` is read at least twice, first for its order columns only. The counts are taken at
    once; the rest runs with the result.
    """
    if order is None:
        return _by_file(df)
    order = [order] if isinstance(order, str) else list(order)
    mark = _mark(df)
    if bucket is not None:
        return _by_key(df, order, bucket, mark)
    if any(_measure(name, df.schema[name].dataType) is None for name in order):
        return _by_key(df, order, order, mark)  # such as structs, a bucket for each
    keyed = _bucketed(df, order, 1 << bits, mark)
    return _by_key(keyed, order, [f"{mark}bucket"], mark).drop(f"{mark}bucket")
