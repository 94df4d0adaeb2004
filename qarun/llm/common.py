"""Small helpers that several operators share."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qarun.scratch import new_path

# Fixed value: the characters [\x20\x09-\x0D], which count as white space.
SPACES = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(column: str | Column) -> Column:
    """The text, or an empty one where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    # `lower` is many times faster than `translate` and the same on plain ASCII.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def without_spaces(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named ``c0, c1, ...``, and these names by the old ones.

    So no column of a user can clash with a helper column, whatever it is called. ``toDF`` with
    the old names brings them back.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*places), dict(zip(reversed(df.columns), reversed(places), strict=True))


class Kept:
    """Tables in the shared folder that belong to one computation.

    ``keep`` runs a frame once and reads it back, which cuts its lineage; ``drop``
    deletes tables that no frame reads any longer.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, frames: Iterable[DataFrame]) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path is not None:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def lent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` written and counted; broadcast up to ``most`` (narrow) rows, beyond it joined by key."""
    back = Kept(df.sparkSession).keep(df, "lent")
    return F.broadcast(back) if back.count() <= most else back
