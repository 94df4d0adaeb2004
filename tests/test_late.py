"""Questions without a record in time, as a stream and as a batch."""

from datetime import datetime, timedelta

import pytest

from qarun.streaming import late_questions

T0 = datetime(2025, 3, 4, 10)
HOUR = timedelta(hours=1)
ASKED = "row_index long, asked timestamp, record_of string"
LOG = "row_index long, ts timestamp"


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


class Streams:
    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, tmp_path
        for name, schema in (("questions", ASKED), ("log", LOG)):
            spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))

    def put(self, questions=(), log=()):
        for name, rows, schema in (("questions", questions, ASKED), ("log", log, LOG)):
            frame = self.spark.createDataFrame(list(rows), schema)
            frame.coalesce(1).write.mode("append").parquet(str(self.path / name))

    def late(self):
        streams = [
            self.spark.readStream.schema(schema).parquet(str(self.path / name))
            for name, schema in (("questions", ASKED), ("log", LOG))
        ]
        found = late_questions(*streams, within=HOUR)
        out = str(self.path / "late")
        once = found.writeStream.format("parquet").outputMode("append")
        once = once.option("checkpointLocation", str(self.path / "checkpoint"))
        once.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.row_index for r in self.spark.read.parquet(out).collect())

    def batch(self):
        frames = [self.spark.read.parquet(str(self.path / name)) for name in ("questions", "log")]
        return late_questions(*frames, within=HOUR)


def test_each_late_question_comes_once_and_as_in_the_batch(spark, tmp_path):
    streams = Streams(spark, tmp_path)
    streams.put(
        [(0, at(0), "own"), (1, at(1), None), (2, at(2), None), (3, at(3), None), (9, None, None)],
        [(0, at(10)), (2, at(62)), (3, at(64)), (7, None)],
    )
    streams.late()  # both streams are at three minutes past ten or a little later
    streams.put([(4, at(200), None), (5, at(230), None)], [(4, at(199)), (5, at(240))])
    assert streams.late() == [1, 3]
    streams.put([(6, at(500), None)], [(6, at(500))])
    assert streams.late() == [1, 3, 4]
    assert streams.late() == [1, 3, 4]
    batch = streams.batch()
    assert batch.columns == ["row_index", "asked", "record_of"]
    assert sorted(r.row_index for r in batch.collect()) == [1, 3, 4]


def test_nulls_repeats_and_empty_tables(spark):
    log = spark.createDataFrame([(None, at(1))], LOG)
    asked = spark.createDataFrame([(None, at(0), None), (1, at(0), None), (1, at(0), None)], ASKED)
    found = late_questions(asked, log, within=HOUR).collect()
    assert sorted(str(r.row_index) for r in found) == ["1", "1", "None"]
    assert late_questions(asked.limit(0), log.limit(0)).count() == 0
    with pytest.raises(ValueError, match="negative"):
        late_questions(asked, log, within=-HOUR)
