"""Operators as stages: documents in, documents out, with all their columns.

Every stage takes ``doc_id`` and ``text``, and any further columns with any names: they come out
as they were. A null text counts as an empty one; an empty table gives an empty table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import Kept, as_text, by_place, lent
from qarun.llm.decontaminate import holding, without_contaminated
from qarun.llm.line_dedup import dedup_lines
from qarun.llm.near_dedup import near_duplicates
from qarun.llm.toxicity import Model, toxicity


def below(docs: DataFrame, model: Model, decision: float) -> DataFrame:
    """The documents whose toxicity is below ``decision``; no column changes."""
    bare, place = by_place(docs)
    return bare.filter(toxicity(model, place["text"]) < decision).toDF(*docs.columns)


def with_distinct_lines(docs: DataFrame) -> DataFrame:
    """Common lines stay in one document, see ``dedup_lines``; no document goes.

    ``text`` changes, a null one to an empty one, and ``n_chars``, if there is such a column,
    follows it.
    """
    bare, place = by_place(docs)
    lined = dedup_lines(bare, id=place["doc_id"], text=place["text"])
    if "n_chars" in place:
        size = F.char_length(place["text"]).cast("bigint")
        lined = lined.withColumn(place["n_chars"], size)
    return lined.select(*bare.columns).toDF(*docs.columns)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, null ids last.

    Rows that share an id but not a text are told apart, and of rows that repeat both, one stays.
    Empty and blank texts are no copies of anything. No column of a row that stays changes.
    """
    bare, place = by_place(docs)
    id, text = place["doc_id"], place["text"]
    odd = bare.groupBy(id).count().filter(f"count > 1 OR {id} IS NULL")
    if odd.isEmpty():
        copies = near_duplicates(bare, id=id, text=text).filter(~F.col("kept"))
        gone = lent(copies.select(F.col("doc_id").alias(id)))
        return bare.join(gone, id, "left_anti").select(*bare.columns).toDF(*docs.columns)
    # An id does not tell a row, so id and text together get a number, in the order of ids.
    kept = Kept(docs.sparkSession)
    key = [F.col(id).alias("of_id"), F.sha2(as_text(text), 256).alias("of_hash")]
    numbers = kept.keep(
        bare.select(*key)
        .distinct()
        .orderBy(F.col("of_id").asc_nulls_last(), "of_hash")
        .withColumn("of_number", F.monotonically_increasing_id()),
        "numbers",
    )
    hashed = bare.withColumn("own_hash", F.sha2(as_text(text), 256))
    same = F.col(id).eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash"))
    numbered = kept.keep(
        hashed.join(numbers, same).select(*bare.columns, "of_number"), "numbered"
    )
    judged = kept.keep(
        near_duplicates(numbered, id="of_number", text=text)
        .groupBy("doc_id")
        .agg(
            F.bool_and("kept").alias("kept"),
            (F.max("n_shingles") > 0).alias("linkable"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumnRenamed("doc_id", "of_number"),
        "judged",
    )
    copies = judged.filter(~F.col("kept")).select("of_number")
    left = numbered.join(lent(copies), "of_number", "left_anti")
    repeated = lent(judged.filter("kept AND linkable AND n > 1").select("of_number"))
    once = left.join(repeated, "of_number", "left_anti")
    # One task sends one row of each at most, so no repeat is too large.
    row = F.struct(*bare.columns).alias("row")
    folded = (
        left.join(repeated, "of_number", "left_semi")
        .groupBy("of_number")
        .agg(F.first(row).alias("row"))
        .select("row.*")
    )
    both = once.select(*bare.columns).unionByName(folded.select(*bare.columns))
    return both.toDF(*docs.columns)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of ``benchmark``; no column changes."""
    bare, place = by_place(docs)
    found = holding(bare, benchmark, id=place["doc_id"], text=place["text"])
    return without_contaminated(docs, found)
