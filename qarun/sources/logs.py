"""Result logs: JSON lines out and in."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qarun.schema import CORRUPT, DAMAGED, RECORD_FIELDS, RECORD_SCHEMA

# Fixed value: how `ts` is written, always in UTC.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"

# Why a row failed; logs of this package have it after the record fields.
ERROR_FIELD = "error"

# Every field is read as text, so that a line is only refused if it is no JSON object.
LOG_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (*RECORD_FIELDS, ERROR_FIELD, CORRUPT)]
)

LOG_OPTIONS = {"columnNameOfCorruptRecord": CORRUPT}


def write_log(
    records: DataFrame, path: str, mode: str = "errorifexists", by_task: bool = False
) -> None:
    """Write one JSON object per line, null fields included.

    ``path`` becomes a directory with one part file per task. The files appear when the
    job ends or, with ``by_task``, each when its task ends; then a run can be watched,
    and what it has written stays if it fails.
    """
    options = {"ignoreNullFields": False, "timestampFormat": TIMESTAMP_FORMAT, "timeZone": "UTC"}
    if by_task:
        options["mapreduce.fileoutputcommitter.algorithm.version"] = 2
    records.write.mode(mode).options(**options).json(path)


def _time(text: Column) -> Column:
    """An ISO time with or without fractions; its own offset, or UTC if it has none."""
    offset = F.regexp_replace(text, r"(:\d\d(?:\.\d+)?[+-]\d\d)(\d\d)$", "$1:$2")
    zoned = F.rlike(offset, F.lit(r"(?:[zZ]|[+-]\d\d:\d\d)\s*\z"))
    in_utc = F.concat(F.rtrim(offset), F.lit("Z"))
    return F.when(zoned, offset).otherwise(in_utc).try_cast("timestamp")


def parsed(raw: DataFrame, error: bool = False) -> DataFrame:
    """The record fields of lines read with ``LOG_SCHEMA``, and what did not fit.

    A value that is not of its field's type becomes null, and ``_damaged`` names the field.
    """
    typed = {
        f.name: _time(F.col(f.name)) if f.name == "ts" else F.trim(f.name).try_cast(f.dataType)
        for f in RECORD_SCHEMA
        if not isinstance(f.dataType, T.StringType)
    }
    unfit = [
        F.when(F.col(name).isNotNull() & value.isNull(), F.lit(name))
        for name, value in typed.items()
    ]
    more = [ERROR_FIELD] if error else []
    return raw.select(
        *[typed.get(name, F.col(name)).alias(name) for name in RECORD_FIELDS],
        *more,
        CORRUPT,
        F.array_compact(F.array(*unfit)).alias(DAMAGED),
    )


def read_log(spark: SparkSession, path: str | Sequence[str], error: bool = False) -> DataFrame:
    """Read one or many logs, by this package or others; ``error`` adds the field of that name.

    A line that is no JSON object, such as one that is cut off, lands in ``_corrupt``. Any other
    line is a record: fields it lacks are null, ``ts`` may have fractions and an offset, and
    ``row_index`` may be text. A value that cannot be read is null and named in ``_damaged``.
    """
    paths = path if isinstance(path, str) else list(path)
    raw = spark.read.schema(LOG_SCHEMA).options(**LOG_OPTIONS).json(paths)
    return parsed(raw, error)


def intact(log: DataFrame) -> DataFrame:
    """The records of a log, without lines that are no object and without empty objects."""
    says_something = F.coalesce(*[F.col(name).cast("string") for name in RECORD_FIELDS]).isNotNull()
    whole = F.col(CORRUPT).isNull() & (says_something | (F.size(DAMAGED) > 0))
    return log.filter(whole).drop(CORRUPT, DAMAGED)


def damaged(log: DataFrame) -> DataFrame:
    """What a log lost: ``field, n``; ``line`` stands for lines that are no object."""
    lost = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("line"))).otherwise(F.col(DAMAGED))
    fields = log.select(F.explode(lost).alias("field"))
    return fields.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def with_run(log: DataFrame) -> DataFrame:
    """Add ``run``: the directory a record was read from."""
    return log.withColumn("run", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1))
