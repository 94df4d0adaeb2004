"""A stream of the lines that are added to growing log files."""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from qarun.sources.files import opened, qualified
from qarun.sources.logs import LOG_OPTIONS, LOG_SCHEMA, intact, parsed

FORMAT = "qarun_tailed_lines"
# Bytes read at a time, in the search for a line end as well as for lines.
BLOCK = 1 << 20
LINES = pa.schema([("path", pa.string()), ("value", pa.string())])


@dataclass
class Stretch(InputPartition):
    """Bytes of a file; lines that begin among them belong to it."""

    path: str
    first: int  # where the new lines of the file begin
    start: int
    end: int


def last_line_end(file: pa.NativeFile, size: int) -> int:
    """The place behind the last line end among the first ``size`` bytes, or 0."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        file.seek(start)
        found = file.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


def lines_from(file: pa.NativeFile, stretch: Stretch) -> Iterator[list[bytes]]:
    """The lines that begin in a stretch, a block's worth at a time."""
    # One byte earlier: if that is a line end, the line behind it is ours, else it is skipped.
    at = max(stretch.first, stretch.start - 1)
    skip = at < stretch.start
    file.seek(at)
    begun = at  # where the line that `rest` holds the start of begins
    rest = []
    while block := file.read(BLOCK):
        pieces = block.split(b"\n")
        pieces[0] = b"".join([*rest, pieces[0]]) if len(pieces) > 1 else pieces[0]
        if len(pieces) == 1:
            rest.append(block)
            continue
        lines = []
        for piece in pieces[:-1]:
            if begun >= stretch.end:
                break
            if not skip:
                lines.append(piece)
            skip = False
            begun += len(piece) + 1
        yield lines
        if begun >= stretch.end:
            return
        rest = [pieces[-1]]


class TailReader(DataSourceStreamReader):
    """Offsets are bytes per file, always behind a line end."""

    def __init__(self, path: str, stretch_bytes: int) -> None:
        self.path, self.stretch_bytes = path, stretch_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = opened(self.path)
        ends = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._" and info.size:
                with system.open_input_file(info.path) as file:
                    ends[info.base_name] = last_line_end(file, info.size)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        stretches = []
        for name, until in sorted(end.items()):
            # A file that got shorter was written anew.
            first = start.get(name, 0) if start.get(name, 0) <= until else 0
            for at in range(first, until, self.stretch_bytes):
                stretches.append(Stretch(name, first, at, min(at + self.stretch_bytes, until)))
        return stretches

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        with system.open_input_file(f"{root}/{stretch.path}") as file:
            for lines in lines_from(file, stretch):
                texts = [text for line in lines if (text := line.decode(errors="replace")).strip()]
                if texts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stretch.path] * len(texts)), pa.array(texts)], schema=LINES
                    )


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options["bytes"]))


def tail_log(
    spark: SparkSession, path: str, bytes_per_task: int = 64 << 20, error: bool = False
) -> DataFrame:
    """Stream the records of the files of a directory while lines are still added to them.

    Each whole line is given once, also over restarts from a checkpoint; a line whose end is
    not there yet waits for a later batch. A line that is no JSON object and one without any
    field is left out, as `intact` does. A file that becomes shorter is read from its start
    again, and so is one that was gone for a batch; one that is rewritten otherwise gives what lies
    behind the old end. Folders are passed over, and files whose names begin with a dot or an underscore.

    A batch is read by one task per ``bytes_per_task`` of new bytes of a file. The driver keeps
    one number per file, in each offset as well, and reads the last block of each file per batch:
    meant for the logs of live runs, some thousand files. `read_log_stream` is for many finished
    files. ``path`` must be of a scheme that Arrow can read.
    """
    if bytes_per_task < 1:
        raise ValueError("bytes_per_task must be at least 1")
    spark.dataSource.register(TailedLines)
    reader = spark.readStream.format(FORMAT).option("bytes", bytes_per_task)
    record = F.from_json("value", LOG_SCHEMA, LOG_OPTIONS)
    lines = reader.load(qualified(spark, path)).select(record.alias("record"))
    return intact(parsed(lines.select("record.*"), error))
