"""Running counts over a growing log directory."""

import datetime
import os
import uuid

import pytest

from qarun.operators import summary
from qarun.sources import intact, read_log
from qarun.streaming import progress

T0 = datetime.datetime(2025, 1, 23, 10, 0, 0)


def line(index, minute=0, status="ok", phase="ask"):
    ts = (T0 + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return (
        f'{{"ts":"{ts}","row_index":{index},"status":"{status}","phase":"{phase}",'
        f'"question":"q{index}","response":null}}\n'
    )


def put(tmp_path, name, *lines):
    """Write a log file aside and move it in whole."""
    aside, log = tmp_path / "aside", tmp_path / "log"
    aside.mkdir(exist_ok=True)
    log.mkdir(exist_ok=True)
    (aside / name).write_text("".join(lines))
    os.rename(aside / name, log / name)
    return str(log)


class Run:
    """One stream that is started again for each look, from the same checkpoint."""

    def __init__(self, tmp_path, counts, mode):
        self.counts, self.mode = counts, mode
        self.name = f"t{uuid.uuid4().hex}"
        self.checkpoint = str(tmp_path / f"checkpoint-{self.name}")

    def look(self):
        stream = (
            self.counts.writeStream.outputMode(self.mode)
            .format("memory")
            .queryName(self.name)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        rows = self.counts.sparkSession.table(self.name).collect()
        return sorted(tuple(row) for row in rows), stream


def test_counts_grow_with_the_files(spark, tmp_path):
    path = put(tmp_path, "1.jsonl", line(0))
    run = Run(tmp_path, progress(spark, path), "complete")
    assert run.look()[0] == [("ok", "ask", 1)]
    put(tmp_path, "2.jsonl", line(1))
    assert run.look()[0] == [("ok", "ask", 2)]
    put(tmp_path, "3.jsonl", line(2), line(3, status="error", phase="start_session"))
    assert run.look()[0] == [("error", "start_session", 1), ("ok", "ask", 3)]


def test_same_as_the_batch_report(spark, tmp_path):
    for i in range(5):
        status = "error" if i % 2 else "ok"
        path = put(tmp_path, f"{i}.jsonl", *[line(10 * i + k, k, status) for k in range(7)])
    counts = progress(spark, path, max_files_per_trigger=2)
    streamed, stream = Run(tmp_path, counts, "complete").look()
    batch = summary(intact(read_log(spark, path)))
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len([p for p in stream.recentProgress if p["numInputRows"]]) == 3


def test_cut_off_line_is_not_counted(spark, tmp_path):
    path = put(tmp_path, "1.jsonl", line(0), line(1), line(2)[:50])
    assert Run(tmp_path, progress(spark, path), "complete").look()[0] == [("ok", "ask", 2)]


def test_windows(spark, tmp_path):
    path = put(tmp_path, "1.jsonl", line(0, 1), line(1, 4), line(2, 11), line(3, 12, "error"))
    rows, _ = Run(tmp_path, progress(spark, path, window="10 minutes"), "complete").look()
    got = sorted((r[0].start, r[1], r[3]) for r in rows)
    ten = T0 + datetime.timedelta(minutes=10)
    assert got == [(T0, "ok", 2), (ten, "error", 1), (ten, "ok", 1)]


def test_watermark_closes_windows_and_drops_late_records(spark, tmp_path):
    path = put(tmp_path, "1.jsonl", line(0, 1), line(1, 4))
    counts = progress(spark, path, window="10 minutes", watermark="5 minutes")
    run = Run(tmp_path, counts, "append")
    # A memory table in append mode cannot resume, so the stream is kept running.
    stream = (
        counts.writeStream.outputMode("append").format("memory").queryName(run.name)
        .option("checkpointLocation", run.checkpoint).start()
    )
    try:
        stream.processAllAvailable()
        assert spark.table(run.name).count() == 0
        put(tmp_path, "2.jsonl", line(2, 40))
        stream.processAllAvailable()
        put(tmp_path, "3.jsonl", line(3, 2), line(4, 41))
        stream.processAllAvailable()
        closed = [(r.window.start, r.status, r.n) for r in spark.table(run.name).collect()]
    finally:
        stream.stop()
    assert closed == [(T0, "ok", 2)]


def test_watermark_needs_a_window(spark, tmp_path):
    with pytest.raises(ValueError, match="window"):
        progress(spark, put(tmp_path, "1.jsonl", line(0)), watermark="5 minutes")
