"""Column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from qarun.schema import OK

# 2**12 = 4,096 values share a bucket, so a window over one bucket stays in memory.
ORDER_BUCKET_BITS = 12


def is_ok(status: Column) -> Column:
    """True only for the word ``ok``; a null status is not ok."""
    return status.eqNullSafe(F.lit(OK))


def is_blank(text: Column) -> Column:
    """Null, empty or only ASCII white space (space, tab, line ends, form feed, vertical tab)."""
    return text.isNull() | text.rlike(r"^[ \t\n\x0B\f\r]*\z")


def long_bucket(number: Column, bits: int = ORDER_BUCKET_BITS) -> Column:
    """Bucket of 2**bits neighbouring integers, rounded down; keeps their order."""
    return F.shiftright(number.cast("bigint"), bits)
