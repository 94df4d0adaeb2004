"""Runs that are stuck, told while they are."""

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROSECOND = timedelta(microseconds=1)


def stalls(
    log: DataFrame,
    run: str,
    threshold: timedelta,
    watermark: timedelta = timedelta(minutes=10),
    ts: str = "ts",
    order: str = "row_index",
) -> DataFrame:
    """The last record before every time a run had no record for more than ``threshold``.

    Gives ``run, order, ts``, of a stream (append mode) or of a batch by the same rule. A stall
    comes out when the records of all runs have passed its threshold by more than ``watermark``,
    which is by how much a record may come late, so also while the run is still stuck or when
    it has ended. ``gaps`` gives the stalls that are over.

    A stretch of records with no such pause is a session window; its state is one row, and it
    is dropped when the stretch is closed. Records without ``ts`` are left out; of those with
    the same ``ts`` the greatest by ``order`` counts. On a stream, a record that comes later
    than ``watermark`` behind the closed stretch it belongs to is not seen.

    On a stream the sessions of a task are merged before the shuffle, so that a run with most of the
    records moves few rows; a batch moves every record, so ``gaps`` and ``stalled`` suit it better.
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    is set for the session if it is not yet.
    """
    for length in (threshold, watermark):
        if length < timedelta(0):
            raise ValueError("threshold and watermark must not be negative")
    spark = log.sparkSession
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    if merge not in spark.conf.getAll:
        spark.conf.set(merge, "true")
    # A window ends before its gap does, so records just `threshold` apart share one.
    pause = threshold // MICROSECOND + 1
    timed = log.select(
        F.col(f"`{run}`").alias("run"),
        F.col(f"`{ts}`").cast("timestamp").alias("ts"),
        F.col(f"`{order}`").alias("order"),
    ).filter(F.col("ts").isNotNull())
    late = watermark // MICROSECOND
    stretches = (
        timed.withWatermark("ts", f"{late} microseconds")
        .groupBy("run", F.session_window("ts", f"{pause} microseconds"))
        .agg(F.max(F.struct("ts", "order")).alias("last"))
    )
    if not log.isStreaming:
        # Watermarks are whole milliseconds.
        passed = timed.agg(F.max(F.unix_millis("ts"))).first()[0]
        known = None if passed is None else (passed - late // 1000) * 1000
        # Not by the end of the window: that would be asked of each record before they are merged.
        stretches = stretches.filter(F.unix_micros("last.ts") + F.lit(pause) <= F.lit(known))
    return stretches.select(
        F.col("run").alias(run), F.col("last.order").alias(order), F.col("last.ts").alias(ts)
    )


def silent_runs(
    log: DataFrame, run: str, threshold: timedelta, ts: str = "ts", order: str = "row_index"
) -> DataFrame:
    """Runs of the stream ``log`` that sent no record for ``threshold`` by the driver's clock.

    Gives ``run, order, ts`` of the run's last record, once per silence, also if no run at all
    sends anything, which ``stalls`` cannot see. Start the stream in append mode with a
    processing-time trigger (with `availableNow` it never ends, as it waits for silence); a run that goes on after that is watched anew. State is one row
    per run that is not silent. Records without ``ts`` do not count, and neither do those without a run.
    """
    if threshold <= timedelta(0):
        raise ValueError("threshold must be positive")
    wait = max(threshold // timedelta(milliseconds=1), 1)
    rows = log.select(
        F.col(f"`{run}`").alias("run"),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("micros"),
        F.col(f"`{order}`").cast("bigint").alias("order"),
    ).filter(F.col("run").isNotNull() & F.col("micros").isNotNull())
    number = T.LongType()
    out = T.StructType(
        [rows.schema["run"], T.StructField("order", number), T.StructField("micros", number)]
    )

    def watch(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            micros, last = state.get
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "order": [last], "micros": [micros]})
            return
        seen = [tuple(state.get)] if state.exists else []
        for part in parts:
            latest = part[part["micros"] == part["micros"].max()]
            numbers = latest["order"].dropna()
            last = None if numbers.empty else int(numbers.max())
            seen.append((int(latest["micros"].iloc[0]), last))
        state.update(max(seen, key=lambda s: (s[0], s[1] is not None, s[1] or 0)))
        state.setTimeoutDuration(wait)

    silent = rows.groupBy("run").applyInPandasWithState(
        watch, out, "micros bigint, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return silent.select(
        F.col("run").alias(run),
        F.col("order").alias(order),
        F.timestamp_micros("micros").alias(ts),
    )
