"""Questions that got no record in time, told while a run is under way."""

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_questions(
    questions: DataFrame,
    log: DataFrame,
    on: str = "row_index",
    within: timedelta = timedelta(hours=1),
    watermark: timedelta = timedelta(minutes=10),
    asked: str = "asked",
    ts: str = "ts",
) -> DataFrame:
    """Rows of ``questions`` without a record in ``log`` from ``asked`` until ``within`` later.

    Two streams, or two batches with the same rule for all that is there. As a stream (append mode)
    a question comes out once, when both streams have passed the end of its time by more than
    ``watermark``, by how much rows of either may come late; later ones are not seen. Until then
    a question is open and not reported, as nobody knows yet. State is kept for ``within`` plus
    ``watermark`` and spread by ``on``; a key that many questions share stays in one state store.

    A record before the question was asked does not count; at either end of the time it does. A
    question without ``on`` has no record. One without ``asked`` has no time, so it is never
    late and left out, and so are records without ``ts``. Repeated questions each come out.
    """
    for length in (within, watermark):
        if length < timedelta(0):
            raise ValueError("within and watermark must not be negative")
    # A literal, as the planner derives from it how long state has to be kept.
    length = F.expr(f"INTERVAL '{within // timedelta(microseconds=1)}' MICROSECOND")
    delay = f"{watermark // timedelta(microseconds=1)} microseconds"
    timed = questions.withColumn(asked, F.col(f"`{asked}`").cast("timestamp"))
    timed = timed.filter(F.col(f"`{asked}`").isNotNull()).withWatermark(asked, delay)
    # The record's columns go by names that no question has.
    key, at = (_unused(name, questions.columns) for name in ("record_of", "recorded"))
    records = log.select(F.col(f"`{on}`").alias(key), F.col(f"`{ts}`").cast("timestamp").alias(at))
    records = records.filter(F.col(at).isNotNull()).withWatermark(at, delay)
    in_time = (
        (F.col(f"`{on}`") == F.col(key))
        & (F.col(at) >= F.col(f"`{asked}`"))
        & (F.col(at) <= F.col(f"`{asked}`") + length)
    )
    if not (questions.isStreaming or log.isStreaming):
        return timed.join(records, in_time, "left_anti")
    return timed.join(records, in_time, "left_outer").filter(F.col(at).isNull()).drop(key, at)


def _unused(name: str, taken: list[str]) -> str:
    lowered = {other.lower() for other in taken}
    while name in lowered:
        name += "_"
    return name
