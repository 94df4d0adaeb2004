"""A whole run from question files to a log, and the first look at that log."""

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from qarun.operators import (
    ask,
    empty_responses,
    errors,
    summary,
    to_record,
    unanswered,
    with_row_index,
    with_session,
)
from qarun.scratch import scratch, written
from qarun.sources import (
    intact,
    read_log,
    read_question_sets,
    write_log,
    write_rolling_log,
)
from qarun.sources.files import exists


def prepare(
    spark: SparkSession, path: str | Sequence[str], run_id: str, normalize: bool = False
) -> DataFrame:
    """Question files as numbered questions, each with a session of its own.

    Each file may name its question column in another of the accepted ways.
    """
    questions = read_question_sets(spark, path, normalize=normalize)
    return with_session(with_row_index(questions), run_id)


def run(
    spark: SparkSession,
    path: str | Sequence[str],
    log_path: str,
    responder: Callable,
    run_id: str,
    open_session: Callable[[], str] | None = None,
    normalize: bool = False,
    parallelism: int | None = None,
    concurrency: int = 1,
    resume: bool = False,
    questions_per_task: int | None = None,
    questions_per_call: int | None = None,
    records_per_file: int | None = None,
) -> DataFrame:
    """Ask every question of the files once, write the log, and return it as read back.

    The log grows as tasks end, so `streaming.progress` can watch it; with ``records_per_file``
    it grows by files of that many records while tasks run (`write_rolling_log`). Behind the record fields
    it has ``error``, which says why a row failed and is null for others.

    With ``resume`` the numbered questions are kept beside the log, in ``<log_path>-questions``,
    and a run that finds them asks only those the log has no record of. So a run that broke
    off can be called again as it was, even if the question files have changed since.

    For ``questions_per_task`` and ``questions_per_call`` see `ask`.
    """
    with scratch(spark):
        if resume:
            kept = log_path.rstrip("/") + "-questions"
            if not exists(spark, f"{kept}/_SUCCESS"):
                numbered = prepare(spark, path, run_id, normalize)
                narrow = numbered.select("row_index", "session_id", "question")
                narrow.write.mode("overwrite").parquet(kept)
            questions = spark.read.parquet(kept)
            if exists(spark, log_path):
                # Written first, as the log grows while it is asked.
                done = written(intact(read_log(spark, log_path)).select("row_index"), "asked")
                questions = unanswered(questions, done, "row_index")
        else:
            questions = prepare(spark, path, run_id, normalize)
        questions = questions.select("row_index", "session_id", "question")
        asked = ask(
            questions,
            responder,
            open_session,
            parallelism,
            concurrency,
            questions_per_task,
            questions_per_call,
        )
        mode = "append" if resume else "errorifexists"
        records = to_record(asked, error=True)
        if records_per_file is None:
            write_log(records, log_path, mode, by_task=True)
        else:
            write_rolling_log(records, log_path, records_per_file, mode)
    return intact(read_log(spark, log_path, error=True))


class Review(NamedTuple):
    """Where a run failed: one lazy frame per report."""

    summary: DataFrame
    errors: DataFrame
    empty: DataFrame
    unanswered: DataFrame


def review(questions: DataFrame, log: DataFrame) -> Review:
    """The failure reports of a run; ``questions`` has the ``row_index`` of the log.

    The log is parsed once and kept in the shared folder, where all four reports read it.
    """
    log = written(log, "review-log")
    return Review(
        summary(log),
        errors(log),
        empty_responses(log),
        unanswered(questions, log, "row_index"),
    )
