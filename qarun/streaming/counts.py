"""Running counts while a log directory grows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qarun.sources.logs import LOG_OPTIONS, LOG_SCHEMA, intact, parsed


def read_log_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream the whole records of a log directory.

    A file is read once, when it appears, so it must be moved in complete.
    ``max_files_per_trigger`` bounds a batch, for a directory that is already large.
    """
    reader = spark.readStream.schema(LOG_SCHEMA).options(**LOG_OPTIONS)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return intact(parsed(reader.json(path)))


def progress_counts(
    records: DataFrame,
    window: str | None = None,
    watermark: str | None = None,
    by: Sequence[str] = ("status", "phase"),
    ts: str = "ts",
) -> DataFrame:
    """Number of records ``n`` by the columns ``by``, and by event-time ``window``.

    Works on a batch or a stream. The state is one number per group. Without
    ``watermark`` start the stream in `complete` (or `update`) mode; with it,
    `append` mode gives each window once it is closed and drops its state.
    """
    if watermark is not None and window is None:
        raise ValueError("a watermark closes windows, so it needs a window")
    keys = [F.col(name) for name in by]
    if window is not None:
        # Event time has to be a TIMESTAMP; one without time zone is taken in the session's.
        records = records.withColumn(ts, F.col(ts).cast("timestamp"))
        if watermark is not None:
            records = records.withWatermark(ts, watermark)
        keys.insert(0, F.window(ts, window))
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def progress(
    spark: SparkSession,
    path: str,
    window: str | None = None,
    watermark: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Running counts by status and phase of a log directory, as a stream."""
    records = read_log_stream(spark, path, max_files_per_trigger)
    return progress_counts(records, window, watermark)
