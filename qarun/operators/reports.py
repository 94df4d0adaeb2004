"""Reports on a result log."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.functions import is_blank, is_ok

# How many rows of one key the log side of `unanswered` may still hold after its
# first pass, however often the log repeats that key.
SALTS = 32


def view(log: DataFrame, n: int | None = None) -> DataFrame:
    """Each question with its response in input order, or the first ``n`` of them."""
    rows = log.select("row_index", "question", "response").orderBy("row_index")
    return rows if n is None else rows.limit(n)


def errors(log: DataFrame) -> DataFrame:
    """Records whose status is not ``ok``; a null status is not ``ok``."""
    return log.filter(~is_ok(F.col("status")))


def empty_responses(log: DataFrame) -> DataFrame:
    """Records without a response text; ``status`` tells errors from empty answers."""
    return log.filter(is_blank(F.col("response")))


def unanswered(questions: DataFrame, log: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Questions that have no record in the log; null keys match nothing.

    Repeats of a key in the log are folded before they meet the questions. The
    last shuffle of both sides is a plain one on the key, which lets adaptive
    execution split a key that many questions share.
    """
    on = [on] if isinstance(on, str) else list(on)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    seen = log.select(*on, salt.alias("_salt")).distinct().select(*on)
    return questions.join(seen, on, "left_anti")


def summary(log: DataFrame) -> DataFrame:
    """Number of records by ``status`` and ``phase``."""
    return log.groupBy("status", "phase").agg(F.count(F.lit(1)).alias("n"))


def shared_sessions(
    df: DataFrame, session: str = "session_id", question: str | None = None
) -> DataFrame:
    """Sessions that carried more than one question, with the number ``n``.

    Every row counts as a question; with ``question`` only rows where it is not
    null. Rows without a session are left out.
    """
    counted = F.lit(1) if question is None else F.col(question)
    return (
        df.filter(F.col(session).isNotNull())
        .groupBy(session)
        .agg(F.count(counted).alias("n"))
        .filter("n > 1")
    )
