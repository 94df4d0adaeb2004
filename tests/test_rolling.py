"""Logs in files of a fixed number of records, and responders that take many questions."""

import json
import pathlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qarun.operators import ask, to_record, with_session
from qarun.plans import run
from qarun.schema import RECORD_FIELDS
from qarun.sources import intact, read_log, write_log, write_rolling_log
from qarun.sources.rolling import BATCH, Closed, RollingWriter


def questions(spark, n, parts=1):
    rows = spark.range(0, n, 1, parts).select(
        F.col("id").alias("row_index"), F.concat(F.lit("q"), "id").alias("question")
    )
    return with_session(rows, "r")


def echo(session_id, question):
    return question


def lines_of(path):
    return {p.name: p.read_text().split("\n")[:-1] for p in pathlib.Path(path).glob("part-*")}


def test_files_hold_a_fixed_number_and_read_like_any_log(spark, tmp_path):
    texts = ['a "b" \\ c', "two\nlines\r", "Grüße \u2028 \x00", "", None]
    rows = questions(spark, 23).withColumn(
        "question", F.get(F.lit(texts), (F.col("row_index") % 5).cast("int"))
    )
    records = to_record(ask(rows, echo, parallelism=2), error=True).withColumn(
        "ts", F.lit("2025-03-04 05:06:07").cast("timestamp")
    )
    before = spark.conf.get(BATCH)
    write_rolling_log(records, str(tmp_path / "rolling"), 4)
    write_log(records, str(tmp_path / "plain"))
    assert spark.conf.get(BATCH) == before
    files = lines_of(tmp_path / "rolling")
    assert sum(map(len, files.values())) == 23
    assert sum(len(lines) < 4 for lines in files.values()) <= 2
    assert all(tuple(json.loads(x))[:6] == RECORD_FIELDS for f in files.values() for x in f)
    both = [
        sorted(map(tuple, intact(read_log(spark, str(tmp_path / name), error=True)).collect()), key=repr)
        for name in ("rolling", "plain")
    ]
    assert both[0] == both[1] and len(both[0]) == 23
    assert (tmp_path / "rolling" / "_SUCCESS").exists()
    assert not list((tmp_path / "rolling").glob("_open*"))
    with pytest.raises(FileExistsError):
        write_rolling_log(records, str(tmp_path / "rolling"), 4)
    write_rolling_log(records, str(tmp_path / "rolling"), 4, mode="append")
    assert intact(read_log(spark, str(tmp_path / "rolling"))).count() == 46


def test_an_empty_log_and_wrong_fields(spark, tmp_path):
    none = to_record(ask(questions(spark, 0), echo, questions_per_task=5))
    write_rolling_log(none, str(tmp_path / "none"), 4)
    assert (tmp_path / "none" / "_SUCCESS").exists()
    assert read_log(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="a log needs the fields"):
        write_rolling_log(spark.range(3), str(tmp_path / "wrong"), 4)
    for bad in ({"per_file": 0}, {"per_file": 3, "mode": "overwrite"}):
        with pytest.raises(ValueError, match="per_file|mode"):
            write_rolling_log(none, str(tmp_path / "bad"), **bad)


def test_commit_drops_what_only_a_failed_attempt_wrote(tmp_path):
    writer = RollingWriter(str(tmp_path), 2, "job")
    for number in range(3):
        (tmp_path / writer._name(0, number)).write_text("{}\n")
    (tmp_path / writer._name(7, 0)).write_text("{}\n")
    other = RollingWriter(str(tmp_path), 2, "another")._name(0, 9)
    (tmp_path / other).write_text("{}\n")
    writer.commit([Closed(0, 2), None])
    kept = {p.name for p in tmp_path.glob("part-*")}
    assert kept == {writer._name(0, 0), writer._name(0, 1), other}


def test_a_run_killed_inside_a_task_keeps_its_closed_files(spark, tmp_path):
    """One task of 60 questions that dies at one of them; texts fill the buffers in between."""
    long = "x" * 20_000
    (tmp_path / "q.csv").write_text("q\n" + "".join(f"q{i}-{long}\n" for i in range(60)))
    asked = tmp_path / "asked"
    asked.mkdir()

    def once(session_id, question):
        (asked / f"{question.split('-')[0]}-{time.monotonic_ns()}").touch()
        return "yes"

    def stops(session_id, question):
        if question.startswith("q55-"):
            time.sleep(3)
            raise SystemExit
        return once(session_id, question)

    source, log = str(tmp_path / "q.csv"), str(tmp_path / "log")
    options = {"parallelism": 1, "questions_per_call": None, "records_per_file": 5, "resume": True}
    chunk, ask.__globals__["CHUNK"] = ask.__globals__["CHUNK"], 5
    try:
        with pytest.raises(Exception, match="SystemExit"):
            run(spark, source, log, stops, "r", **options)
    finally:
        ask.__globals__["CHUNK"] = chunk
    known = {r.question.split("-")[0] for r in intact(read_log(spark, log)).collect()}
    assert 0 < len(known) < 55
    assert all(len(lines) == 5 for lines in lines_of(log).values())
    assert not list(pathlib.Path(log).glob("_open*"))
    first = Counter(p.name.split("-")[0] for p in asked.iterdir())
    rows = run(spark, source, log, once, "r", **options).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(60))
    again = Counter(p.name.split("-")[0] for p in asked.iterdir())
    assert all(again[q] == first[q] for q in known)


def test_a_task_that_is_run_again_writes_no_record_twice(spark, tmp_path):
    log, flag = tmp_path / "log", tmp_path / "failed"
    writer = RollingWriter(str(log), 3, "job")

    def attempt(batches):
        from qarun.sources import rolling

        rolling.TaskContext = type("Task", (), {"get": staticmethod(lambda: Part)})
        return writer.write(batches)

    class Part:
        partitionId = staticmethod(lambda: 0)

    import pyarrow as pa

    def batches(n, die):
        for i in range(0, n, 2):
            if die and i >= die:
                raise RuntimeError("lost")
            yield pa.RecordBatch.from_pylist([{"row_index": k} for k in range(i, min(i + 2, n))])

    from qarun.sources import rolling

    context = rolling.TaskContext
    try:
        with pytest.raises(RuntimeError):
            attempt(batches(11, die=8))
        assert sum(map(len, lines_of(log).values())) == 6 and not flag.exists()
        writer.commit([attempt(batches(11, die=0))])
    finally:
        rolling.TaskContext = context
    found = sorted(json.loads(x)["row_index"] for f in lines_of(log).values() for x in f)
    assert found == list(range(11))


@pytest.mark.parametrize("concurrency", [1, 3])
def test_a_responder_of_many_questions(spark, concurrency):
    def many(sessions, asked):
        assert len(sessions) == len(asked) <= 4
        if "q9" in asked:
            raise OSError("whole call")
        if "q20" in asked:
            return ["too few"]
        return [KeyError(q) if q == "q2" else None if q == "q3" else f"{s}:{q}" for s, q in zip(sessions, asked)]

    df = ask(questions(spark, 24), many, None, 1, concurrency, questions_per_call=4)
    rows = df.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(24))
    assert rows[0].response == "r-0:q0" and rows[0].status == "ok"
    assert (rows[2].status, rows[2].error) == ("error", "KeyError: 'q2'")
    assert (rows[3].status, rows[3].response) == ("ok", None)
    assert {rows[i].error for i in range(8, 12)} == {"OSError: whole call"}
    assert {rows[i].error for i in range(20, 24)} == {"ValueError: 1 answers to 4 questions"}
    assert sum(r.status == "error" for r in rows) == 9


def test_rows_without_a_session_are_not_asked(spark):
    calls = iter(range(100))

    def open_session():
        if next(calls) % 3 == 0:
            raise ConnectionError("closed")
        return "s"

    def many(sessions, asked):
        return [str(len(asked))] * len(asked)

    rows = ask(questions(spark, 6), many, open_session, 1, questions_per_call=3).collect()
    assert sum((r.phase, r.status, r.session_id) == ("start_session", "error", None) for r in rows) == 2
    assert {r.response for r in rows if r.status == "ok"} == {"2"}


def shuffles(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_questions_and_even_parts_stay(spark):
    cores = spark.sparkContext.defaultParallelism
    many = ask(questions(spark, 4000), echo, questions_per_task=100)
    assert many.rdd.getNumPartitions() == 40 and shuffles(many)
    few = ask(questions(spark, 40), echo, questions_per_task=100)
    assert few.rdd.getNumPartitions() == cores
    even = ask(questions(spark, 4000, parts=cores), echo, questions_per_task=1000)
    assert even.rdd.getNumPartitions() == cores and not shuffles(even)
    lopsided = questions(spark, 4000).union(questions(spark, 8, parts=cores))
    assert shuffles(ask(lopsided, echo, questions_per_task=1000))
    with pytest.raises(ValueError, match="not both"):
        ask(questions(spark, 1), echo, parallelism=2, questions_per_task=3)
    with pytest.raises(ValueError, match="at least 1"):
        ask(questions(spark, 1), echo, questions_per_call=0)
