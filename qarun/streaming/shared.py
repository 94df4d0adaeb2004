"""Sessions that carry a second question, told when it comes."""

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per session of an Arrow batch, so a hot session is folded before the shuffle."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by("session")
        counts = rows.aggregate([("at", "count"), ("at", "max")])
        counts = counts.select(["session", "at_count", "at_max"])
        yield from counts.rename_columns(["session", "n", "at"]).combine_chunks().to_batches()


def _id(session: Column, kind: T.DataType) -> Column:
    """A whole number or a string for each session, so that the state is the same for all types."""
    if isinstance(kind, (T.IntegralType, T.StringType)):
        return session
    if isinstance(kind, T.BinaryType):
        return F.hex(session)
    if isinstance(kind, T.TimestampType):  # as a string, two hours of the year would be one
        return F.unix_micros(session)
    return session.cast("string")


def shared_sessions_live(
    asked: DataFrame,
    session: str = "session_id",
    question: str | None = None,
    keep: timedelta = timedelta(days=1),
    watermark: timedelta = timedelta(minutes=10),
    ts: str = "ts",
    groups: int = 2048,
) -> DataFrame:
    """Each session of the stream ``asked`` that carries more than one question, once.

    The column ``session`` comes out in the micro-batch that brings the second question; start
    the stream in append mode. ``shared_sessions`` gives the same sessions from a table.

    Every row counts as a question; with ``question`` only rows where it is not null. Rows
    without a session or without ``ts`` are left out, and so are those that come later than
    ``watermark``. State is the session and two numbers per session, dropped when the records have passed
    the last question of the session by ``keep`` and ``watermark``. A later question starts it anew, so
    questions further apart than that are not told.

    Sessions are dealt over ``groups`` states by their hash, as a call of Python costs some
    milliseconds and a session in it some microseconds: a micro-batch makes at most ``groups`` calls. It
    writes the states anew that its questions and the sessions to be dropped belong to, so give more
    groups where many millions of sessions are open and few are asked at a time. A checkpoint keeps to its number.
    """
    if keep <= timedelta(0) or watermark < timedelta(0):
        raise ValueError("keep must be positive and watermark not negative")
    if groups < 1:
        raise ValueError("groups must be positive")
    wait = max(keep // timedelta(milliseconds=1), 1)
    rows = asked.select(
        F.col(f"`{session}`").alias("session"),
        F.col(f"`{ts}`").cast("timestamp").alias("at"),
        (F.lit(1) if question is None else F.col(f"`{question}`")).alias("question"),
    )
    rows = rows.dropna().select("session", "at")
    own = rows.schema["session"]
    if isinstance(own.dataType, (T.FloatType, T.DoubleType)):  # 0.0 and -0.0 are one session
        rows = rows.withColumn("session", F.col("session") + F.lit(0).cast(own.dataType))

    def second(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = {id_: (n, until) for id_, n, until in zip(*state.get)} if state.exists else {}
        for part in [] if state.hasTimedOut else parts:
            told = []
            counts = zip(part["id"].tolist(), part["n"].tolist(), part["millis"].tolist())
            for place, (id_, count, millis) in enumerate(counts):
                n, until = known.get(id_, (0, wait))
                # The watermark may have passed what is left of a session that was about to go.
                known[id_] = (n + count, max(until, millis + wait, now + 1))
                if n < 2 <= n + count:
                    told.append(place)
            if told:
                yield part[["session"]].iloc[told]
        known = {id_: kept for id_, kept in known.items() if kept[1] >= now}
        if not known:
            state.remove()
            return
        counts, ends = zip(*known.values())
        state.update((list(known), list(counts), list(ends)))
        state.setTimeoutTimestamp(min(ends))

    fields = [own, T.StructField("n", T.LongType()), T.StructField("at", T.TimestampType())]
    counted = rows.mapInArrow(_folded, T.StructType(fields))
    counted = counted.withWatermark("at", f"{watermark // timedelta(microseconds=1)} microseconds")
    counted = counted.withColumns(
        {"id": _id(F.col("session"), own.dataType), "millis": F.unix_millis("at")}
    ).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    packed = T.StructType(
        [
            T.StructField("ids", T.ArrayType(counted.schema["id"].dataType)),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
        ]
    )
    found = counted.groupBy("group").applyInPandasWithState(
        second, T.StructType([own]), packed, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumnRenamed("session", session)
