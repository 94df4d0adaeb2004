"""Stalls and shared sessions, told while a log grows."""

import random
import time
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from qarun.operators import gaps, shared_sessions
from qarun.streaming import shared_sessions_live, silent_runs, stalls

T0 = datetime(2025, 3, 4, 10)
HOUR = timedelta(hours=1)
LOG = "run string, row_index long, ts timestamp"
ASKED = "session_id string, question string, ts timestamp"


class Stream:
    """A table that grows by files, and what a stream over it has given so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.parquet(f"{path}/in")

    def put(self, rows):
        frame = self.spark.createDataFrame(list(rows), self.schema)
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def source(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")

    def start(self, frame, **trigger):
        query = frame.writeStream.format("parquet").outputMode("append")
        query = query.option("checkpointLocation", f"{self.path}/checkpoint")
        return query.trigger(**trigger).start(f"{self.path}/out")

    def run(self, frame):
        query = self.start(frame, availableNow=True)
        query.awaitTermination()
        return query

    def rows(self, schema=None):
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        found = reader.parquet(f"{self.path}/out")
        return sorted(map(tuple, found.collect()), key=repr)


def test_stalls_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for run in ("a", "b", None):
        at = T0
        for index in range(60):
            at += timedelta(minutes=rng.choice([0, 1, 20, 60, 61, 200]))
            rows.append((run, index, at))
    rows.append(("only nulls", 1, None))
    rows.append(("tie", None, T0))
    rows.append(("tie", 5, T0))
    stream = Stream(spark, tmp_path, LOG)
    ordered = sorted(rows, key=lambda r: r[2] or T0)
    for part in range(3):
        stream.put(ordered[part * 61 : (part + 1) * 61])
        stream.run(stalls(stream.source(), "run", HOUR))
    log = spark.createDataFrame(rows, LOG).repartition(5)
    batch = sorted(map(tuple, stalls(log, "run", HOUR).collect()), key=repr)
    assert stream.rows() == batch

    last = max(r[2] for r in rows if r[2]) - timedelta(minutes=10)
    want = []
    for run in ("a", "b", None, "tie"):
        own = sorted(((r[2], r[1] or 0) for r in rows if r[0] == run and r[2]))
        for (at, index), after in zip(own, [*own[1:], None], strict=True):
            ends = after is None or after[0] - at > HOUR
            if ends and at + HOUR + timedelta(microseconds=1) <= last:
                want.append((run, index, at))
    assert batch == sorted(want, key=repr)
    assert ("tie", 5, T0) in batch
    # Those that are over by then are gaps as well.
    over = {(r.run, r.prev_ts) for r in gaps(log, "run", HOUR).collect()}
    ends = {run: max(r[2] for r in rows if r[0] == run and r[2]) for run in ("a", "b", None, "tie")}
    assert over >= {(run, at) for run, _, at in batch if at < ends[run]}


def test_stalls_of_an_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert stalls(log, "run", HOUR).collect() == []
    with pytest.raises(ValueError, match="negative"):
        stalls(log, "run", -HOUR)


def test_a_silent_run_is_told_without_any_further_record(spark, tmp_path):
    stream = Stream(spark, tmp_path, LOG)
    stream.put([("a", 1, T0), ("a", 2, T0), ("a", None, T0), ("b", 1, None), (None, 1, T0)])
    watched = silent_runs(stream.source(), "run", timedelta(seconds=1))
    query = stream.start(watched, processingTime="200 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and not (tmp_path / "out").exists():
            time.sleep(0.2)
        while time.time() < until and not stream.rows(LOG):
            time.sleep(0.5)
        assert stream.rows(LOG) == [("a", 2, T0)]
    finally:
        query.stop()
    with pytest.raises(ValueError, match="positive"):
        silent_runs(stream.source(), "run", timedelta(0))


def test_a_session_is_told_with_its_second_question(spark, tmp_path):
    stream = Stream(spark, tmp_path, ASKED)
    live = shared_sessions_live(stream.source(), question="question")
    later = T0 + HOUR
    first = [("a", "why", T0), ("b", "why", T0), ("b", "how", T0), (None, "x", T0), (None, "y", T0)]
    stream.put([*first, ("c", None, T0), ("c", "why", T0), ("", "why", T0), ("c", "x", None)])
    stream.run(live)
    assert stream.rows() == [("b",)]
    stream.put([("a", "how", later), ("b", "again", later), ("c", None, later)])
    stream.run(live)
    assert stream.rows() == [("a",), ("b",)]
    stream.put([("hot", "same", later)] * 5000 + [("", "how", later)])
    stream.run(live)
    assert stream.rows() == [("",), ("a",), ("b",), ("hot",)]
    table = spark.read.parquet(f"{tmp_path}/in").filter("ts IS NOT NULL")
    table = shared_sessions(table, question="question")
    assert sorted((r.session_id,) for r in table.collect()) == stream.rows()


def test_the_state_of_old_sessions_is_dropped(spark, tmp_path):
    stream = Stream(spark, tmp_path, ASKED)
    live = shared_sessions_live(stream.source(), keep=HOUR)
    sizes = []
    for number in range(3):
        at = T0 + 5 * number * HOUR
        stream.put([(f"{number}-{i}", "why", at) for i in range(20)])
        query = stream.run(live)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sizes == [20, 20, 20]
    stream.put([("0-0", "how", T0 + 10 * HOUR), ("2-0", "how", T0 + 10 * HOUR)])
    stream.run(live)  # the first question of 0-0 is forgotten
    assert stream.rows() == [("2-0",)]
    with pytest.raises(ValueError, match="positive"):
        shared_sessions_live(stream.source(), keep=timedelta(0))


def test_sessions_share_states_and_are_dropped_one_by_one(spark, tmp_path):
    stream = Stream(spark, tmp_path, ASKED)
    live = shared_sessions_live(stream.source(), keep=HOUR, groups=1)
    minutes = timedelta(minutes=1)
    found, sizes = [], []
    for asked in (
        [("a", 0), ("b", 30), ("told", 30), ("told", 30)],
        [("c", 80), ("told", 80)],  # a is forgotten by this, b is not
        [("a", 75), ("b", 75)],
        [("a", 76), ("c", 76), ("b", 76)],
    ):
        stream.put([(name, "why", T0 + at * minutes) for name, at in asked])
        query = stream.run(live)
        found.append([name for (name,) in stream.rows()])
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert found == [["told"], ["told"], ["b", "told"], ["a", "b", "c", "told"]]
    assert sizes == [1, 1, 1, 1]
    stream.put([("d", "why", T0 + 50 * HOUR)])
    stream.run(live)
    stream.put([("a", "why", T0 + 50 * HOUR), ("d", "why", T0 + 50 * HOUR)])
    stream.run(live)
    assert stream.rows() == [("a",), ("b",), ("c",), ("d",), ("told",)]
    with pytest.raises(ValueError, match="groups"):
        shared_sessions_live(stream.source(), groups=0)


def test_many_sessions_make_no_more_states_than_groups(spark, tmp_path):
    stream = Stream(spark, tmp_path, ASKED)
    live = shared_sessions_live(stream.source())
    stream.put((f"{i}", "why", T0) for i in range(6000))
    stream.put((f"{i}", "why", T0) for i in range(0, 6000, 3))
    query = stream.run(live)
    assert sorted(int(name) for (name,) in stream.rows()) == [*range(0, 6000, 3)]
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2048


@pytest.mark.parametrize(
    "kind, first, other, again",
    [
        ("bigint", 1, 2, 1),
        ("double", 0.0, 1.5, -0.0),
        ("binary", b"\xff", b"\xfe", b"\xff"),
        ("decimal(20,3)", Decimal("1.500"), Decimal("1.501"), Decimal("1.500")),
        ("date", date(2025, 1, 1), date(2025, 1, 2), date(2025, 1, 1)),
        ("timestamp", T0, T0 + timedelta(microseconds=1), T0),
    ],
)
def test_sessions_of_any_type_are_told(spark, tmp_path, kind, first, other, again):
    stream = Stream(spark, tmp_path, f"session_id {kind}, ts timestamp")
    live = shared_sessions_live(stream.source(), groups=2)
    stream.put([(first, T0), (other, T0)])
    stream.run(live)
    assert stream.rows() == []
    stream.put([(again, T0)])
    stream.run(live)
    assert stream.rows() == [(first,)]
