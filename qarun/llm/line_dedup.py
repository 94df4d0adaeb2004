"""Line dedup: lines that many documents hold stay in one of them only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import SPACES, as_text, ascii_lower


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, id: str, text: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough: document, text hash, place and key hashes."""
    key = line_key(F.col("line"))
    return (
        docs.select(F.col(id).alias("doc"), as_text(text).alias("text"))
        .select("doc", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
        .select("doc", "text_hash", F.posexplode("lines").alias("at", "line"))
        .select("doc", "text_hash", "at", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        # 128 bits: two hashes with different seeds.
        .select(
            "doc",
            "text_hash",
            "at",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
        )
    )


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold, but in the largest id.

    Gives ``docs`` with ``text`` reassembled by position from the lines that stay, plus
    ``n_lines`` (before dropping) and ``n_dropped``, each replacing a column of that name.
    A text is split at ``\\n``; keys shorter than ``min_chars`` code points never go.

    Null text: one empty line. Null id: the row counts as no document and keeps all its
    lines. Rows that share an id are one document: they count once, and all of them keep
    or lose a line. An empty table gives no rows; other columns pass through untouched.

    Only hashes travel: lines are folded by hash and document before the shuffle, so a line
    that a third of all documents hold is one row per task there. The join that tells
    documents what to drop is a plain equi-join, which adaptive execution splits at hot lines.
    """
    lines = _lines(docs, id, text, min_chars).filter(F.col("doc").isNotNull())
    # Counted by another key than the join's, so that both sides of the join are shuffled for
    # it alone and a hot line can be split there.
    common = (
        lines.groupBy(F.bitwise_not("h1").alias("o1"), "h2")
        .agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select(F.bitwise_not("o1").alias("h1"), "h2", "keeper")
    )
    drops = (
        lines.join(common, ["h1", "h2"])
        .filter(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("at").alias("gone"))
    )

    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(id).alias("doc"), F.xxhash64(as_text(text)).alias("text_hash"))
    here = as_text(F.col("row").getField(text))
    split = F.split(here, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda at: F.get(split, at)), "\n")
    counts = {
        "n_lines": F.size(split).cast("bigint"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
    }
    others = [name for name in docs.columns if name.lower() not in counts]
    columns = {name: F.col("row").getField(name) for name in others}
    columns[text] = F.when(F.col("gone").isNull(), here).otherwise(kept)
    return rows.join(drops, ["doc", "text_hash"], "left").select(
        *[value.alias(name) for name, value in {**columns, **counts}.items()]
    )
