"""Sessions and batch ask, with responders that answer on the spot."""

import datetime
import json
import pathlib
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from qarun.operators import ask, shared_sessions, summary, with_row_index, with_session
from qarun.plans import prepare, review, run
from qarun.schema import ASK, START_SESSION
from qarun.scratch import shared_dir
from qarun.sources import intact, read_log
from qarun.streaming import progress

THREE = ["Which river runs through the old town?", "Where can I hand in a lost key?"]
THREE += ["Is the library open on Mondays?"]


def table(spark, questions):
    rows = [(i, q) for i, q in enumerate(questions)]
    return with_session(spark.createDataFrame(rows, "row_index long, question string"), "r1")


def test_session_is_one_per_row_and_stable(spark):
    df = table(spark, THREE)
    keys = [r.session_id for r in df.orderBy("row_index").collect()]
    assert keys == ["r1-0", "r1-1", "r1-2"]
    assert [r.session_id for r in df.repartition(5).orderBy("row_index").collect()] == keys
    assert shared_sessions(df).count() == 0


def answer(session_id, question):
    if question == "bad":
        raise RuntimeError("no answer")
    return f"{session_id}: {question}"


@pytest.mark.parametrize("parallelism", [1, 3, 11, None])
@pytest.mark.parametrize("concurrency", [1, 4])
def test_one_bad_row_does_not_stop_the_others(spark, parallelism, concurrency):
    df = ask(table(spark, ["a", "bad", "c", None]), answer, None, parallelism, concurrency)
    rows = df.orderBy("row_index").collect()
    assert [(r.question, r.session_id, r.status, r.phase, r.response) for r in rows] == [
        ("a", "r1-0", "ok", ASK, "r1-0: a"),
        ("bad", "r1-1", "error", ASK, None),
        ("c", "r1-2", "ok", ASK, "r1-2: c"),
        (None, "r1-3", "ok", ASK, "r1-3: None"),
    ]
    if parallelism:
        assert df.rdd.getNumPartitions() == parallelism


def test_open_session_replaces_the_key_and_may_fail(spark, tmp_path):
    opened = str(tmp_path)

    def open_session():
        name = f"{threading.get_ident()}-{datetime.datetime.now().timestamp()}"
        made = len(list(pathlib.Path(opened).iterdir()))
        (pathlib.Path(opened) / name).touch()
        if made == 1:
            raise ConnectionError("no session")
        return f"s{made}"

    df = ask(table(spark, ["a", "b", "c"]), answer, open_session, parallelism=1).collect()
    rows = sorted(tuple(map(str, (r.phase, r.status, r.session_id, r.response))) for r in df)
    assert [r[:3] for r in rows] == [
        (ASK, "ok", "s0"),
        (ASK, "ok", "s2"),
        (START_SESSION, "error", "None"),
    ]
    assert rows[2][3] == "None"
    assert len(list(pathlib.Path(opened).iterdir())) == 3


def test_a_session_is_needed(spark):
    bare = spark.createDataFrame([(0, "a")], "row_index long, question string")
    with pytest.raises(ValueError, match="session_id"):
        ask(bare, answer)
    assert ask(bare, answer, lambda: "x").first().session_id == "x"


def test_other_columns_pass_through_unchanged(spark):
    df = table(spark, ["a", "b"]).select(
        "*",
        F.when(F.col("row_index") == 0, F.lit(2**60 + 1)).alias("big"),
        F.array(F.lit(1), F.lit(None)).alias("list"),
        F.lit("old").alias("response"),
    )
    rows = ask(df, answer).orderBy("row_index").collect()
    assert [r.big for r in rows] == [2**60 + 1, None]
    assert rows[0].list == [1, None]
    assert [r.response for r in rows] == ["r1-0: a", "r1-1: b"]
    assert [r.response_ for r in rows] == ["old", "old"]


@pytest.mark.parametrize("header", ["S.No.", "Response", "STATUS", "Error", "a`b", "ts", "Phase"])
def test_ordinary_headers_do_not_stop_a_run(spark, tmp_path, header):
    (tmp_path / "q.csv").write_text(f"{header},question\n1,a\n2,bad\n")
    log = run(spark, str(tmp_path / "q.csv"), str(tmp_path / "log"), answer, "r")
    rows = log.orderBy("row_index").collect()
    assert [(r.status, r.response) for r in rows] == [("ok", "r-0: a"), ("error", None)]
    assert [r.error for r in rows] == [None, "RuntimeError: no answer"]
    mine = ask(prepare(spark, str(tmp_path / "q.csv"), "r"), answer)
    name = header if header in mine.columns and header == "S.No." else mine.columns[0]
    assert sorted(r[name] for r in mine.collect()) == ["1", "2"]


def test_a_session_without_a_key_is_an_error(spark):
    for key in (None, ""):
        [row] = ask(table(spark, ["a"]), answer, lambda key=key: key).collect()
        assert (row.session_id, row.status, row.phase) == (None, "error", START_SESSION)
        assert row.error == "ValueError: open_session gave no session key"


def test_a_broken_run_is_finished(spark, tmp_path):
    (tmp_path / "q.csv").write_text("q\n" + "".join(f"q{i}\n" for i in range(40)))
    asked = tmp_path / "asked"
    asked.mkdir()

    def once(session_id, question):
        (asked / f"{question}-{time.monotonic_ns()}").touch()
        return question

    def stops(session_id, question):
        if question == "q33":
            raise SystemExit
        return once(session_id, question)

    source, log_path = str(tmp_path / "q.csv"), str(tmp_path / "log")
    with pytest.raises(Exception, match="SystemExit"):
        run(spark, source, log_path, stops, "r", parallelism=8, resume=True)
    known = {r.question for r in intact(read_log(spark, log_path)).collect()}
    assert 0 < len(known) < 40
    for file in asked.iterdir():
        if file.name.split("-")[0] not in known:
            file.unlink()
    (tmp_path / "q.csv").write_text("q\nanother file by now\n")
    log = run(spark, source, log_path, once, "r", resume=True)
    rows = log.orderBy("row_index").collect()
    assert [(r.row_index, r.question) for r in rows] == [(i, f"q{i}") for i in range(40)]
    assert len(list(asked.iterdir())) == 40
    assert run(spark, source, log_path, once, "r", resume=True).count() == 40
    assert len(list(asked.iterdir())) == 40


def test_time_of_asking_is_utc_now(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        asked = ask(table(spark, ["a"]), answer).select(F.unix_seconds("ts")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs(asked - datetime.datetime.now(datetime.UTC).timestamp()) < 60


def test_none_and_other_answers(spark):
    rows = ask(table(spark, ["a"]), lambda s, q: None).collect()
    assert [(r.status, r.response) for r in rows] == [("ok", None)]
    assert ask(table(spark, ["a"]), lambda s, q: 7).first().response == "7"


def test_whole_run(spark, tmp_path):
    source, log_path = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    (source / "a.csv").write_text("question\n" + "\n".join(THREE) + "\n")
    (source / "b.csv").write_text('question\nbad\n"two\nlines"\n')

    log = run(spark, str(source), log_path, answer, "r1", parallelism=3)
    rows = log.orderBy("row_index").collect()
    asked = [*THREE, "bad", "two\nlines"]
    assert [(r.row_index, r.question) for r in rows] == list(enumerate(asked))
    assert [r.status for r in rows] == ["ok", "ok", "ok", "error", "ok"]
    assert rows[4].response == "r1-4: two\nlines"
    raw = [
        json.loads(line)
        for part in pathlib.Path(log_path).glob("part-*")
        for line in part.read_text().splitlines()
    ]
    assert all(set(r) == set(log.columns) for r in raw)

    report = review(prepare(spark, str(source), "r1"), log.filter("row_index <> 2"))
    assert {(r.status, r.n) for r in report.summary.collect()} == {("ok", 3), ("error", 1)}
    assert [r.question for r in report.errors.collect()] == ["bad"]
    assert [r.question for r in report.empty.collect()] == ["bad"]
    assert [r.question for r in report.unanswered.collect()] == [THREE[2]]
    assert summary(log).count() == 2


def test_index_then_ask_spreads_a_small_table(spark):
    df = spark.range(400).select(F.col("id"), F.concat(F.lit("q"), "id").alias("question"))
    numbered = with_session(with_row_index(df, ["id"]), "r")
    asked = ask(numbered, answer, parallelism=8)
    per_task = asked.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 100


def test_a_run_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    (tmp_path / "q.csv").write_text("q\na\nb\n")
    before = set(pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("qarun-*"))
    log = run(spark, str(tmp_path / "q.csv"), str(tmp_path / "log"), answer, "r")
    assert log.count() == 2
    assert set(pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("qarun-*")) == before


def test_a_run_can_be_watched(spark, tmp_path):
    """Ten tasks, one of which waits: the others' records are in the log before it ends."""
    (tmp_path / "q.csv").write_text("q\nwait\n" + "".join(f"q{i}\n" for i in range(60)))
    go, log_path = tmp_path / "go", tmp_path / "log"

    def slow(session_id, question):
        until = time.monotonic() + 90
        while question == "wait" and not go.exists() and time.monotonic() < until:
            time.sleep(0.05)
        return question

    with ThreadPoolExecutor(1) as pool:
        done = pool.submit(
            run, spark, str(tmp_path / "q.csv"), str(log_path), slow, "r", parallelism=10
        )
        while not done.done() and len(list(log_path.glob("part-*"))) < 9:
            time.sleep(0.05)
        try:
            name = "watched_run"
            stream = (
                progress(spark, str(log_path))
                .writeStream.outputMode("complete")
                .format("memory")
                .queryName(name)
                .option("checkpointLocation", str(tmp_path / "checkpoint"))
                .trigger(availableNow=True)
                .start()
            )
            stream.awaitTermination()
            watched = spark.table(name).collect()
            assert not done.done()
        finally:
            go.touch()
        assert done.result().count() == 61
    [row] = watched
    assert (row.status, row.phase) == ("ok", "ask") and 40 <= row.n < 61
