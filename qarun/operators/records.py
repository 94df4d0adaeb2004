"""The result record."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.schema import RECORD_SCHEMA


def to_record(df: DataFrame, error: bool = False) -> DataFrame:
    """Exactly the six record fields, in order; ``ts`` cut to whole seconds.

    ``error`` keeps the column of that name as a seventh.
    """
    more = [F.col("error").cast("string").alias("error")] if error else []
    record = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA]
    return df.select(*record, *more).withColumn("ts", F.date_trunc("second", "ts"))
