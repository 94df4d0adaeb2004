"""From raw documents to token ids: the stages of the corpus pipeline, in order.

What a stage does with nulls, repeated rows and further columns is said in ``qarun.llm.stages``.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qarun.llm.bpe import digests, encode, read_vocabulary
from qarun.llm.common import Kept, by_place, table
from qarun.llm.queries import DECISION, toxicity_model
from qarun.llm.stages import below, with_distinct_lines, without_near_copies, without_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the decision score stay."""
    return below(docs, toxicity_model(spark, sf_dir), DECISION)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in one document; ``n_chars`` follows the text, no document goes."""
    return with_distinct_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    return without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage stay."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left as token ids, with digests of ids and decoded text.

    The last stage gives ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and no other column.
    """
    content = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    bare, place = by_place(docs)
    return digests(encode(bare, content, id=place["doc_id"], text=place["text"]))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", non_toxic),
    ("line dedup", distinct_lines),
    ("near-dedup", distinct_documents),
    ("decontamination", decontaminated),
    ("BPE", token_ids),
]

# Trained models and sketches are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    kept = Kept(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = kept.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
