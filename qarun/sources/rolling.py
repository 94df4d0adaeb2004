"""A log that grows by files, each closed after a fixed number of records."""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from qarun.schema import RECORD_FIELDS
from qarun.sources.files import exists, move_over, opened, qualified

FORMAT = "qarun_rolling_log"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Closed(WriterCommitMessage):
    """How many files a task has closed; their names follow from its number."""

    part: int
    files: int


def _line(record: dict) -> str:
    ts = record.get("ts")
    if isinstance(ts, datetime):
        record["ts"] = ts.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n"


class RollingWriter(DataSourceArrowWriter):
    """Writes a file under a hidden name and moves it in once it is whole.

    File k of part p has the same name in every attempt of its task. So a task that is run again
    puts its files over those of the attempt before, and the log has each record once.
    """

    def __init__(self, path: str, records: int, job: str) -> None:
        self.path, self.records, self.job = path, records, job

    def _name(self, part: int, number: int) -> str:
        return f"part-{part:05d}-{self.job}-{number:06d}.json"

    def _aside(self, root: str) -> str:
        return f"{root}/_open-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Closed:
        system, root = opened(self.path)
        part = TaskContext.get().partitionId()
        lines: list[str] = []
        files = 0

        def close() -> None:
            nonlocal files
            open_file = f"{self._aside(root)}/{part}-{uuid.uuid4().hex}"
            with system.open_output_stream(open_file) as out:
                out.write("".join(lines[: self.records]).encode())
            move_over(system, open_file, f"{root}/{self._name(part, files)}")
            del lines[: self.records]
            files += 1

        system.create_dir(self._aside(root), recursive=True)
        for batch in iterator:
            lines.extend(map(_line, batch.to_pylist()))
            while len(lines) >= self.records:
                close()
        if lines:
            close()
        return Closed(part, files)

    def commit(self, messages: list[Closed | None]) -> None:
        """Drop files that only a failed attempt has written, and mark the log as whole."""
        system, root = opened(self.path)
        files = {m.part: m.files for m in messages if m is not None}
        system.create_dir(root, recursive=True)
        for info in system.get_file_info(fs.FileSelector(root)):
            name = info.base_name.removesuffix(".json").split("-")
            if name[0] == "part" and name[2:3] == [self.job]:
                if int(name[3]) >= files.get(int(name[1]), 0):
                    system.delete_file(info.path)
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Closed | None]) -> None:
        """Keep every closed file: its questions need not be asked again."""
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._aside(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._aside(root))


class RollingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> RollingWriter:
        if tuple(schema.names[: len(RECORD_FIELDS)]) != RECORD_FIELDS:
            raise ValueError(f"a log needs the fields {', '.join(RECORD_FIELDS)}")
        # A run that goes on with a log must not write over the files that are there.
        return RollingWriter(self.options["path"], int(self.options["records"]), uuid.uuid4().hex)


def write_rolling_log(
    records: DataFrame, path: str, per_file: int, mode: str = "errorifexists"
) -> None:
    """Write a log, as `write_log` does, in files of ``per_file`` records that appear when full.

    Each task closes its files one after another; its last one may be shorter. If the job fails,
    all closed files stay. A record waits for the ``per_file`` records of its file, and for as
    many as fill the buffer between Spark and Python (64 KB). No records give an empty log.

    A task that is run again replaces its own files, so if it meets the same records in the same
    order, as behind `ask`, a file is only ever replaced by one with the same questions. Parts
    that change between attempts end up right as well, but only with the end of the job.

    ``mode`` is `errorifexists` or `append`. A task holds one file and one batch. The driver
    gets two numbers per task and lists the folder once. ``path`` has to be of a scheme that
    Arrow can write.
    """
    if per_file < 1:
        raise ValueError("per_file must be at least 1")
    if mode not in ("append", "errorifexists"):
        raise ValueError("a rolling log is written with mode append or errorifexists")
    spark = records.sparkSession
    if mode == "errorifexists" and exists(spark, path):
        raise FileExistsError(path)
    spark.dataSource.register(RollingLog)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(per_file, int(before) if int(before) > 0 else per_file))
    try:
        write = records.write.format(FORMAT).mode("append").option("records", per_file)
        write.save(qualified(spark, path))
    finally:
        spark.conf.set(BATCH, before)
