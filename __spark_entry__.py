"""Queries the driver runs, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qarun.operators import (
    ask,
    empty_responses,
    errors,
    gaps,
    pair_turns,
    shared_sessions,
    stalled,
    summary,
    to_record,
    unanswered,
    view,
    with_row_index,
    with_session,
)
from qarun.plans import recorded_results as recorded
from qarun.plans import prepare, review, run
from qarun.schema import RECORD_FIELDS
from qarun.scratch import new_path, written
from qarun.sources import (
    intact,
    read_log,
    read_question_sets,
    read_questions,
    resolve_question,
    with_run,
    write_log,
)
from qarun.sources.files import move_over, opened, qualified
from qarun.streaming import progress as log_progress_stream
from qarun.streaming import late_questions as late_stream
from qarun.streaming import progress_counts, shared_sessions_live, stalls, tail_log

# A package of its own, which may be left out, and what it needs may be missing. Then its
# entries go, and no others.
try:
    from qarun.llm import queries as llm
except ImportError as missing:
    warnings.warn(f"queries of the language-model package are left out: {missing}", stacklevel=2)
    llm = None
try:
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
    from corpus_pipeline import run as pipeline
except ImportError as missing:
    warnings.warn(f"the pipeline is left out: {missing}", stacklevel=2)
    pipeline = PIPELINE_SQL = None

SMOKE_DIR = "/root/testdata/sf0.001"

# The conversations carry no time of asking; a log made of them has this one.
LOG_TIME = "2025-03-04 10:40:15"
RUN_ID = "run"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).filter(F.col("role") == "user")


def _write_csv(questions: DataFrame, path: str) -> None:
    questions.write.csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def _naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


def _drain(counts: DataFrame) -> DataFrame:
    """Run a counting stream over all present files; the result is one row per group.

    Every batch holds all groups and replaces the table that the one before has written.
    """
    spark = counts.sparkSession
    path = new_path(spark, "counts")
    spark.createDataFrame([], counts.schema).write.parquet(path)
    stream = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", new_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


def recorded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(_conversations(spark, sf_dir))


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(recorded_results(spark, sf_dir))


# Texts with nothing to see in them; the last three hold more than ASCII white space.
BLANKS = ("", " \t", "\n", "\x0b\x0c", "\x85", "\u2028", " \xa0")


def empty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every third conversation are replaced by blank ones."""
    blank = F.get(F.lit(list(BLANKS)), (F.col("conv_id") + F.col("turn")).cast("int") % len(BLANKS))
    replaced = F.when(F.col("conv_id") % 3 == 0, blank).otherwise(F.col("response"))
    results = recorded_results(spark, sf_dir)
    return empty_responses(results.withColumn("response", replaced))


def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(recorded_results(spark, sf_dir), 20)


def all_results_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(recorded_results(spark, sf_dir))


def status_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(pair_turns(_conversations(spark, sf_dir)))


def unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = (
        _conversations(spark, sf_dir)
        .filter(F.col("role") == "assistant")
        .select("conv_id", (F.col("turn") - 1).alias("turn"))
    )
    asked = _user_turns(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("question"))
    return unanswered(asked, replies, ["conv_id", "turn"])


def shared_session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_sessions(_user_turns(spark, sf_dir), "conv_id", "text")


def csv_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "question-files")
    benchmark = _table(spark, sf_dir, "benchmark")
    _write_csv(benchmark.orderBy("item_id").select(F.col("text").alias("q")), path)
    return with_row_index(resolve_question(read_questions(spark, path)))


def csv_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "question-files")
    turns = _user_turns(spark, sf_dir).orderBy("conv_id", "turn")
    _write_csv(turns.select("conv_id", "turn", F.col("text").alias("questions")), path)
    return with_row_index(resolve_question(read_questions(spark, path)))


def csv_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without and with line ends in their values, read together."""
    path = new_path(spark, "question-files")
    benchmark, turns = _table(spark, sf_dir, "benchmark"), _user_turns(spark, sf_dir)
    plain = F.regexp_replace("text", r"[\r\n]+", " ").alias("question")
    _write_csv(benchmark.select(F.col("item_id").alias("id"), plain), f"{path}/plain")
    number = (F.col("conv_id") * 10_000 + F.col("turn")).alias("id")
    ends = F.concat("text", F.lit("\n\r\nend")).alias("question")
    _write_csv(turns.select(number, ends), f"{path}/ends")
    files = read_questions(spark, [f"{path}/plain", f"{path}/ends"])
    return with_row_index(resolve_question(files)).select("id", "question")


def csv_two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of files of which some call their questions ``q`` and some ``question``."""
    path = new_path(spark, "question-files")
    benchmark = _table(spark, sf_dir, "benchmark").orderBy("item_id")
    turns = _user_turns(spark, sf_dir).orderBy("conv_id", "turn")
    _write_csv(benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("q")), f"{path}/a")
    _write_csv(turns.select(F.col("text").alias("question"), "conv_id", "turn"), f"{path}/b")
    return with_row_index(read_question_sets(spark, [f"{path}/a", f"{path}/b"]))


def csv_split_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with both kinds of line end in its values and CR LF behind its rows."""
    path = new_path(spark, "question-files")
    number = F.col("conv_id") * 10_000 + F.col("turn")
    value = F.concat(F.replace("text", F.lit('"'), F.lit('""')), F.lit("\n\r\nend"))
    row = F.format_string('%d,"%s"\r', number, value)
    header = spark.range(1).select(F.lit(-1).alias("at"), F.lit("id,question\r").alias("row"))
    turns = _user_turns(spark, sf_dir).select(number.alias("at"), row.alias("row"))
    # One file, so that its splits cut it; rows are put in order by `at`.
    header.union(turns).coalesce(1).sortWithinPartitions("at").select("row").write.text(path)
    return with_row_index(resolve_question(read_questions(spark, path)))


def indexed_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _user_turns(spark, sf_dir).select("text", "conv_id", "turn")
    return with_row_index(asked, ["text", "conv_id", "turn"])


def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _user_turns(spark, sf_dir).select("conv_id", "turn")
    return with_session(with_row_index(asked, ["conv_id", "turn"]), RUN_ID)


def _log(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "log")
    timed = recorded_results(spark, sf_dir).withColumn("ts", F.lit(LOG_TIME))
    write_log(to_record(timed), path)
    return path


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intact(read_log(spark, _log(spark, sf_dir))).withColumn("ts", _naive("ts"))


def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(log_progress_stream(spark, _log(spark, sf_dir)))


def _answer(session_id: str, question: str) -> str:
    """An answer that takes the whole question, and a failure by what it says."""
    digest = hashlib.md5(question.encode()).hexdigest()
    if digest[0] in "0123":
        raise ValueError(f"refused {digest}")
    return f"A: {digest}"


def batch_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = recorded_results(spark, sf_dir).select("row_index", "question")
    asked = written(ask(with_session(questions, RUN_ID), _answer), "asked")
    return asked.drop("ts")


def _answers(session_ids: list[str], questions: list[str]) -> list[str | Exception]:
    """The answers of ``_answer`` to many questions at once."""
    answers: list[str | Exception] = []
    for session_id, question in zip(session_ids, questions, strict=True):
        try:
            answers.append(_answer(session_id, question))
        except ValueError as refused:
            answers.append(refused)
    return answers


def batch_responder(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = with_session(recorded_results(spark, sf_dir).select("row_index", "question"), RUN_ID)
    asked = ask(questions, _answers, questions_per_task=2_000, questions_per_call=64)
    return written(asked, "asked").drop("ts")


def _no_session() -> str:
    raise ConnectionError("no session today")


def ask_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = recorded_results(spark, sf_dir).select("row_index", "conv_id", "question")
    closed = F.col("conv_id") % 3 == 0
    without = ask(questions.filter(closed), _answer, _no_session)
    opened = ask(questions.filter(~closed), _answer, lambda: "open")
    return written(without.unionByName(opened), "asked").drop("ts")


def _question_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "question-files")
    turns = _user_turns(spark, sf_dir).orderBy("conv_id", "turn")
    _write_csv(turns.select(F.col("text").alias("question")), path)
    return path


def file_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, log = _question_files(spark, sf_dir), new_path(spark, "log")
    return run(spark, files, log, _answer, RUN_ID).drop("ts")


def rolling_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose log grows by files of fifty records."""
    files, log = _question_files(spark, sf_dir), new_path(spark, "log")
    sizes = {"questions_per_task": 2_000, "records_per_file": 50}
    return run(spark, files, log, _answer, RUN_ID, **sizes).drop("ts")


def _half_run(spark: SparkSession, files: str) -> str:
    """The log of a run that has asked every other question."""
    log = f"{new_path(spark, 'log')}/log"  # its questions are kept beside it
    first = ask(prepare(spark, files, RUN_ID), _answer).filter("row_index % 2 = 0")
    write_log(to_record(first, error=True), log)
    return log


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _question_files(spark, sf_dir)
    log = intact(read_log(spark, _half_run(spark, files)))
    found = review(prepare(spark, files, RUN_ID), log)
    reports = {"error": found.errors, "empty": found.empty, "unanswered": found.unanswered}
    rows = [
        report.select(F.lit(name).alias("report"), "row_index", "question")
        for name, report in reports.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of which half the log is there already."""
    files = _question_files(spark, sf_dir)
    return run(spark, files, _half_run(spark, files), _answer, RUN_ID, resume=True).drop("ts")


def _grow(lines: DataFrame, path: str, whole: bool) -> None:
    """One file per part with its lines in order; the same file if a task is run again.

    More lines in ``lines`` make every file longer. The last line lacks its end if not ``whole``.
    """
    spark = lines.sparkSession
    uri = qualified(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lines.repartition(parts, "row_index").sortWithinPartitions("delivery", "row_index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(uri)
        system.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():05d}.jsonl"
        aside = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            last = b""
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write(last)
                    last = line.encode() + b"\n"
            out.write(last if whole else last[:-8])
        move_over(system, aside, f"{root}/{name}")
        yield from ()

    spread.select("line").mapInArrow(write, "line string").write.format("noop").mode(
        "overwrite"
    ).save()


def tailed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that grow by three deliveries, of which the first two end inside a line.

    The stream is started for each delivery, from the checkpoint of the one before.
    """
    log, found = new_path(spark, "growing-log"), new_path(spark, "tailed")
    checkpoint = new_path(spark, "progress")
    timed = recorded_results(spark, sf_dir).withColumn("ts", F.lit(LOG_TIME + "Z"))
    line = F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"})
    lines = timed.select((F.col("row_index") % 3).alias("delivery"), "row_index", line.alias("line"))
    lines = written(lines, "lines")
    stream = tail_log(spark, log)
    for delivery in range(3):
        _grow(lines.filter(F.col("delivery") <= delivery), log, whole=delivery == 2)
        once = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        once.trigger(availableNow=True).start(found).awaitTermination()
    return spark.read.schema(stream.schema).parquet(found).withColumn("ts", _naive("ts"))


def foreign_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a line of a log that another program might have written."""
    kind = F.col("turn") % 4
    ts = (
        F.when(kind == 0, "2025-03-04T10:40:15.123Z")
        .when(kind == 1, "2025-03-04T11:40:15+01:00")
        .when(kind == 2, "2025-03-04T05:10:15-0530")
        .otherwise("later")
    )
    number = (F.col("conv_id") * 10_000 + F.col("turn")).cast("string")
    line = F.to_json(
        F.struct(
            ts.alias("ts"),
            number.alias("row_index"),
            F.when(F.col("conv_id") % 5 != 0, "ok").alias("status"),
            F.col("role").alias("phase"),
            F.col("text").alias("question"),
            F.lit("x").alias("unknown"),
        )
    )
    path = new_path(spark, "foreign-log")
    _conversations(spark, sf_dir).select(line).write.text(path)
    return intact(read_log(spark, path)).withColumn("ts", _naive("ts"))


def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalls in the logs of several runs, told apart by their folders."""
    events = _table(spark, sf_dir, "events").filter(F.col("ts").isNotNull())
    logs = []
    for run_number in range(4):
        logs.append(f"{new_path(spark, 'log')}/run{run_number}")
        own = events.filter(F.col("user_id") % 4 == run_number).select(
            "ts",
            F.col("event_id").alias("row_index"),
            F.lit("ok").alias("status"),
            F.lit("ask").alias("phase"),
            F.col("event_type").alias("question"),
            F.lit(None).cast("string").alias("response"),
        )
        write_log(to_record(own), logs[-1])
    found = gaps(intact(with_run(read_log(spark, logs))), "run", timedelta(minutes=30))
    return found.withColumns(
        {
            "run": F.regexp_extract("run", "[^/]+$", 0),
            "prev_ts": _naive("prev_ts"),
            "ts": _naive("ts"),
        }
    )


def record_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return gaps(events, "user_id", timedelta(days=1), order="event_id")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A file stream takes a single file only by a pattern; it also fits a directory.
    pattern = f"{sf_dir}/events.parquet*"
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(pattern)
    counts = _drain(progress_counts(events, window="1 day", by=["event_type"]))
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"
    )


def open_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that had no record for a day when the last record of all came in."""
    events = _table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return stalled(events, "user_id", timedelta(days=1), now, order="event_id")


def late_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of each pair of events is the record of the first, if it is no error.

    It may take five minutes.
    """
    pattern = f"{sf_dir}/events.parquet*"
    schema = _table(spark, sf_dir, "events").schema
    number = F.expr("event_id div 2").alias("row_index")

    def half(odd: int, ts: str) -> DataFrame:
        events = spark.readStream.schema(schema).parquet(pattern)
        own = (F.col("event_id") % 2 == odd) & (F.lit(odd == 0) | (F.col("event_type") != "error"))
        return events.filter(own).select(number, F.col("ts").alias(ts))

    late = late_stream(half(0, "asked"), half(1, "ts"), within=timedelta(minutes=5))
    found = new_path(spark, "late")
    once = late.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "progress"))
    once.trigger(availableNow=True).start(found).awaitTermination()
    return spark.read.schema(late.schema).parquet(found).withColumn("asked", _naive("asked"))


def _delivered(
    frames: list[DataFrame], live: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """What a stream gives, in append mode, that is started again for each delivery."""
    spark, schema = frames[0].sparkSession, frames[0].schema
    log, found = new_path(spark, name), new_path(spark, f"{name}-found")
    checkpoint = new_path(spark, "progress")
    stream = live(spark.readStream.schema(schema).parquet(f"{log}/*"))
    for number, frame in enumerate(frames):
        frame.write.parquet(f"{log}/{number}")
        once = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        once.trigger(availableNow=True).start(found).awaitTermination()
    return spark.read.schema(stream.schema).parquet(found)


def live_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pause of a user of more than a day, from two deliveries in order of time."""
    events = _table(spark, sf_dir, "events")
    ends = events.agg(F.date_trunc("day", F.min("ts")), F.max("ts")).first()
    early = F.col("ts") < F.lit(ends[0] + (ends[1] - ends[0]) / 2)
    found = _delivered(
        [events.filter(early), events.filter(~early)],
        lambda log: stalls(log, "user_id", timedelta(days=1), order="event_id"),
        "stalls",
    )
    return found.withColumn("ts", _naive("ts"))


def shared_sessions_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events in a row are a session, which an error does not use; delivered by their halves."""
    events = _table(spark, sf_dir, "events").filter(F.col("ts").isNotNull())
    asked = events.withColumns(
        {
            "session_id": F.expr("event_id div 2"),
            "question": F.when(F.col("event_type") != "error", F.col("event_type")),
        }
    )
    halves = [asked.filter(F.col("event_id") % 2 == half) for half in (0, 1)]
    # Both deliveries cover the whole time, so a row may come as late as the table is long.
    whole = timedelta(days=3650)
    return _delivered(
        halves,
        lambda log: shared_sessions_live(log, question="question", keep=whole, watermark=whole),
        "sessions",
    )


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that no record can join any longer, from a stream that is started for each delivery.

    The last delivery has records of the first day, which come too late.
    """
    events = _table(spark, sf_dir, "events")
    first = F.lit(events.agg(F.date_trunc("day", F.min("ts"))).first()[0])
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < first + F.expr("INTERVAL 1 DAY"))
    early = F.col("ts") < first + F.expr("INTERVAL 10 DAYS")
    log, found = new_path(spark, "events"), new_path(spark, "closed")
    checkpoint = new_path(spark, "progress")
    stream = spark.readStream.schema(events.schema).parquet(f"{log}/*")
    counts = progress_counts(stream, window="1 day", watermark="1 hour", by=["event_type"])

    def keep(batch: DataFrame, number: int) -> None:  # the same table if a batch runs again
        batch.write.mode("overwrite").parquet(f"{found}/batch={number}")

    for number, part in enumerate((early & ~late, ~early, late)):
        events.filter(part).write.parquet(f"{log}/{number}")
        run_once = counts.writeStream.outputMode("append").foreachBatch(keep)
        run_once = run_once.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        run_once.start().awaitTermination()
    closed = spark.read.schema(counts.schema).parquet(f"{found}/batch=*")
    return closed.select(
        F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n"
    )


def entry(spark: SparkSession) -> DataFrame:
    """Every recorded question with its answer, from the smallest tables."""
    return recorded_results(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {} if llm is None else llm.queries()
    if pipeline is not None:
        more = {**more, "pipeline": pipeline}
    return {
        **more,
        "recorded_results": recorded_results,
        "error_records": error_records,
        "empty_responses": empty_records,
        "unanswered_questions": unanswered_questions,
        "status_phase_counts": status_phase_counts,
        "shared_sessions": shared_session_report,
        "first_results": first_results,
        "all_results_in_order": all_results_in_order,
        "csv_questions": csv_questions,
        "csv_user_turns": csv_user_turns,
        "csv_mixed_files": csv_mixed_files,
        "csv_two_headers": csv_two_headers,
        "csv_split_quoted": csv_split_quoted,
        "indexed_by_text": indexed_by_text,
        "session_keys": session_keys,
        "log_round_trip": log_round_trip,
        "log_progress": log_progress,
        "batch_ask": batch_ask,
        "ask_with_sessions": ask_with_sessions,
        "batch_responder": batch_responder,
        "file_run": file_run,
        "rolling_log": rolling_log,
        "tailed_log": tailed_log,
        "resumed_run": resumed_run,
        "review_report": review_report,
        "foreign_log_scan": foreign_log_scan,
        "log_gaps": log_gaps,
        "record_gaps": record_gaps,
        "progress": progress,
        "open_stalls": open_stalls,
        "live_stalls": live_stalls,
        "shared_sessions_live": shared_sessions_told,
        "closed_windows": closed_windows,
        "late_questions": late_questions,
    }


RECORDED_SQL = """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index, conv_id, turn,
       CASE WHEN next_role = 'assistant' THEN 'ok' ELSE 'error' END AS status,
       'ask' AS phase, text AS question,
       CASE WHEN next_role = 'assistant' THEN next_text END AS response
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user'
"""


ASKED_SQL = f"""
SELECT row_index, CASE WHEN refused THEN 'error' ELSE 'ok' END AS status,
       'ask' AS phase, question,
       CASE WHEN NOT refused THEN 'A: ' || digest END AS response,
       CASE WHEN refused THEN 'ValueError: refused ' || digest END AS error
FROM (SELECT *, md5(question) AS digest, left(md5(question), 1) < '4' AS refused
      FROM ({RECORDED_SQL}))
"""

BLANKS_SQL = "'', ' ' || chr(9), chr(10), chr(11) || chr(12), chr(133), chr(8232), ' ' || chr(160)"


def oracle_sql() -> dict[str, str]:
    counts = f"SELECT status, phase, count(*) AS n FROM ({RECORDED_SQL}) GROUP BY status, phase"
    more = {} if llm is None else llm.oracle_sql()
    if PIPELINE_SQL is not None:
        more["pipeline"] = PIPELINE_SQL
    return {
        **more,
        "recorded_results": RECORDED_SQL,
        "error_records": f"SELECT * FROM ({RECORDED_SQL}) WHERE status IS DISTINCT FROM 'ok'",
        "empty_responses": f"""
            SELECT * FROM (
                SELECT * REPLACE (CASE WHEN conv_id % 3 = 0
                                  THEN [{BLANKS_SQL}][(conv_id + turn) % {len(BLANKS)} + 1]
                                  ELSE response END AS response)
                FROM ({RECORDED_SQL}))
            WHERE response IS NULL
               OR trim(response, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''""",
        "unanswered_questions": """
            SELECT conv_id, turn, text AS question FROM conversations q
            WHERE role = 'user' AND NOT EXISTS (
                SELECT 1 FROM conversations a
                WHERE a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1)""",
        "status_phase_counts": counts,
        "shared_sessions": """
            SELECT conv_id, count(text) AS n FROM conversations
            WHERE role = 'user' AND conv_id IS NOT NULL
            GROUP BY conv_id HAVING count(text) > 1""",
        "first_results": f"""
            SELECT row_index, question, response FROM ({RECORDED_SQL})
            ORDER BY row_index LIMIT 20""",
        "all_results_in_order": f"""
            SELECT row_index, question, response FROM ({RECORDED_SQL}) ORDER BY row_index""",
        "csv_questions": """
            SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_index, text AS question
            FROM benchmark""",
        "csv_user_turns": """
            SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index,
                   CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
                   text AS question
            FROM conversations WHERE role = 'user'""",
        "csv_mixed_files": """
            SELECT CAST(item_id AS VARCHAR) AS id,
                   regexp_replace(text, '[\r\n]+', ' ', 'g') AS question FROM benchmark
            UNION ALL
            SELECT CAST(conv_id * 10000 + turn AS VARCHAR),
                   text || chr(10) || chr(13) || chr(10) || 'end'
            FROM conversations WHERE role = 'user'""",
        "csv_two_headers": """
            SELECT row_number() OVER (ORDER BY part, item_id, conv_id, turn) - 1 AS row_index,
                   question, CAST(item_id AS VARCHAR) AS item,
                   CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn
            FROM (SELECT 0 AS part, item_id, NULL AS conv_id, NULL AS turn, text AS question
                  FROM benchmark
                  UNION ALL
                  SELECT 1, NULL, conv_id, turn, text FROM conversations WHERE role = 'user')""",
        "csv_split_quoted": """
            SELECT row_number() OVER (ORDER BY conv_id * 10000 + turn) - 1 AS row_index,
                   CAST(conv_id * 10000 + turn AS VARCHAR) AS id,
                   text || chr(10) || chr(13) || chr(10) || 'end' AS question
            FROM conversations WHERE role = 'user'""",
        "indexed_by_text": """
            SELECT text, conv_id, turn,
                   row_number() OVER (ORDER BY encode(text) NULLS FIRST, conv_id, turn) - 1 AS row_index
            FROM conversations WHERE role = 'user'""",
        "session_keys": f"""
            SELECT conv_id, turn, row_index, '{RUN_ID}-' || row_index AS session_id FROM (
                SELECT conv_id, turn,
                       row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index
                FROM conversations WHERE role = 'user')""",
        "log_round_trip": f"""
            SELECT TIMESTAMP '{LOG_TIME}' AS ts, row_index, status, phase, question, response
            FROM ({RECORDED_SQL})""",
        "log_progress": counts,
        "batch_ask": f"""
            SELECT row_index, '{RUN_ID}-' || row_index AS session_id,
                   status, phase, question, response, error FROM ({ASKED_SQL})""",
        "ask_with_sessions": f"""
            SELECT row_index, conv_id, question,
                   CASE WHEN NOT closed THEN 'open' END AS session_id,
                   CASE WHEN closed THEN 'error' ELSE status END AS status,
                   CASE WHEN closed THEN 'start_session' ELSE phase END AS phase,
                   CASE WHEN NOT closed THEN response END AS response,
                   CASE WHEN closed THEN 'ConnectionError: no session today' ELSE error END AS error
            FROM (SELECT a.*, r.conv_id, r.conv_id % 3 = 0 AS closed
                  FROM ({ASKED_SQL}) a JOIN ({RECORDED_SQL}) r USING (row_index))""",
        "resumed_run": ASKED_SQL,
        "review_report": f"""
            SELECT unnest(CASE WHEN row_index % 2 = 1 THEN ['unanswered']
                               WHEN status = 'error' THEN ['error', 'empty'] END) AS report,
                   row_index, question
            FROM ({ASKED_SQL})""",
        "foreign_log_scan": """
            SELECT CASE turn % 4 WHEN 0 THEN TIMESTAMP '2025-03-04 10:40:15.123'
                                 WHEN 3 THEN NULL ELSE TIMESTAMP '2025-03-04 10:40:15' END AS ts,
                   conv_id * 10000 + turn AS row_index,
                   CASE WHEN conv_id % 5 <> 0 THEN 'ok' END AS status, role AS phase,
                   text AS question, CAST(NULL AS VARCHAR) AS response
            FROM conversations""",
        "log_gaps": """
            SELECT run, row_index, prev_ts, ts,
                   date_diff('microsecond', prev_ts, ts) AS gap_micros
            FROM (SELECT 'run' || (user_id % 4) AS run, event_id AS row_index,
                         date_trunc('second', ts) AS ts,
                         lag(date_trunc('second', ts)) OVER (
                             PARTITION BY user_id % 4
                             ORDER BY date_trunc('second', ts), event_id) AS prev_ts
                  FROM events WHERE ts IS NOT NULL)
            WHERE date_diff('microsecond', prev_ts, ts) > 1800000000""",
        "batch_responder": f"""
            SELECT row_index, '{RUN_ID}-' || row_index AS session_id,
                   status, phase, question, response, error FROM ({ASKED_SQL})""",
        "file_run": ASKED_SQL,
        "rolling_log": ASKED_SQL,
        "tailed_log": f"""
            SELECT TIMESTAMP '{LOG_TIME}' AS ts, row_index, status, phase, question, response
            FROM ({RECORDED_SQL})""",
        "record_gaps": """
            SELECT user_id, event_id, prev_ts, ts,
                   date_diff('microsecond', prev_ts, ts) AS gap_micros
            FROM (SELECT user_id, event_id, ts, lag(ts) OVER (
                      PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
                  FROM events WHERE ts IS NOT NULL)
            WHERE date_diff('microsecond', prev_ts, ts) > 86400000000""",
        "open_stalls": """
            SELECT user_id, event_id, ts, date_diff('microsecond', ts, last) AS gap_micros
            FROM (SELECT user_id, event_id, ts, max(ts) OVER () AS last, row_number() OVER (
                      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
                  FROM events WHERE ts IS NOT NULL)
            WHERE place = 1 AND date_diff('microsecond', ts, last) > 86400000000""",
        "live_stalls": """
            SELECT user_id, event_id, ts
            FROM (SELECT user_id, event_id, ts, lead(ts) OVER (
                             PARTITION BY user_id ORDER BY ts, event_id) AS next_ts,
                         date_trunc('millisecond', max(ts) OVER ()) - INTERVAL 10 MINUTE AS known
                  FROM events WHERE ts IS NOT NULL)
            WHERE (next_ts IS NULL OR date_diff('microsecond', ts, next_ts) > 86400000000)
              AND date_diff('microsecond', ts, known) > 86400000000""",
        "shared_sessions_live": """
            SELECT event_id // 2 AS session_id FROM events
            WHERE event_type <> 'error' AND ts IS NOT NULL
            GROUP BY session_id HAVING count(*) > 1""",
        "closed_windows": """
            SELECT day, event_type, count(*) AS n
            FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type,
                         max(ts) OVER () AS last,
                         event_id % 50 = 0 AND date_trunc('day', ts)
                             = date_trunc('day', min(ts) OVER ()) AS late
                  FROM events WHERE ts IS NOT NULL)
            WHERE NOT late AND day + INTERVAL 1 DAY <= last - INTERVAL 1 HOUR
            GROUP BY day, event_type""",
        "late_questions": """
            WITH halves AS (SELECT event_id // 2 AS row_index, event_id % 2 AS odd, ts
                            FROM events WHERE event_id % 2 = 0 OR event_type <> 'error'),
                 ends AS (SELECT least(max(ts) FILTER (WHERE odd = 0), max(ts) FILTER (WHERE odd = 1))
                                 - INTERVAL 10 MINUTE AS known FROM halves)
            SELECT q.row_index, q.ts AS asked FROM halves q, ends
            WHERE q.odd = 0 AND q.ts + INTERVAL 5 MINUTE < known AND NOT EXISTS (
                SELECT 1 FROM halves r WHERE r.odd = 1 AND r.row_index = q.row_index
                    AND r.ts BETWEEN q.ts AND q.ts + INTERVAL 5 MINUTE)""",
        "progress": """
            SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n
            FROM events GROUP BY ALL""",
    }
