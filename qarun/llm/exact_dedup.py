"""Exact dedup: counting quotient filters find repeated fingerprints, bytes confirm them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import Kept, as_text, without_spaces

# 2**12 blocks of quotients: each merge task holds one block of every partition's filter.
QUOTIENT_BITS = 12


def _filter_of(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One filter as a row per quotient in use: its sorted remainders and their counts."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
    fingerprints, counts = fingerprints[first], np.add.reduceat(counts, first)
    shift = np.uint64(64 - bits)
    quotients = (fingerprints >> shift).astype(np.int32)
    remainders = (fingerprints & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]])
    offsets = pa.array(np.r_[starts, len(quotients)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(quotients[starts]),
            pa.ListArray.from_arrays(offsets, pa.array(remainders)),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        ],
        names=["quotient", "remainders", "counts"],
    )


def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The filter of one partition; a long partition gives several, which merge as well."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        rows += len(waiting[-1])
        if rows >= 1 << 20:
            yield _filter_of(np.concatenate(waiting), np.ones(rows, np.int64), bits)
            waiting, rows = [], 0
    if rows:
        yield _filter_of(np.concatenate(waiting), np.ones(rows, np.int64), bits)


def _merge(block: pa.Table, bits: int) -> pa.Table:
    """Merge the runs of one quotient by remainder; counts add up, so nothing is lost."""
    quotient = np.uint64(block.column("quotient")[0].as_py())
    remainders = block.column("remainders").combine_chunks().flatten().to_numpy()
    counts = block.column("counts").combine_chunks().flatten().to_numpy()
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]])
    counts = np.add.reduceat(counts, first)
    high = quotient << np.uint64(64 - bits)
    fingerprints = (remainders[first].astype(np.uint64) | high).view(np.int64)
    return pa.table({"fingerprint": fingerprints[counts > 1], "n": counts[counts > 1]})


def repeated_fingerprints(fingerprints: DataFrame, bits: int = QUOTIENT_BITS) -> DataFrame:
    """Fingerprints (the one ``bigint`` column) that occur more than once, with counts ``n``.

    Every partition builds a counting quotient filter: the top ``bits`` of a fingerprint are
    its quotient, the rest its remainder, kept sorted per quotient with a count. Filters are
    merged per quotient. A hot fingerprint is one entry of each filter.
    """
    filters = fingerprints.mapInArrow(
        lambda batches: _build(batches, bits),
        "quotient int, remainders array<bigint>, counts array<bigint>",
    )
    return filters.groupBy("quotient").applyInArrow(
        lambda block: _merge(block, bits), "fingerprint bigint, n bigint"
    )


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the group of equal texts it is in and who stays.

    Gives ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal when
    identical after deleting all ASCII white space. Of a group the row with the most code
    points in its original text stays, then the one with the smallest id; a null id comes
    after all others. ``text_sha256`` is of the text without white space.

    Null text counts as empty, so null, empty and blank texts form one group. Rows that share
    both id and text are the same document: all carry ``kept`` if their id stays. An empty
    table gives no rows; other columns are not read.

    A fingerprint that occurs once needs no look at its bytes. The others are grouped by the
    bytes themselves, folded in each task before the shuffle, so a group of any size sends
    one copy of its text per task.
    """
    kept = Kept(docs.sparkSession)
    texts = docs.select(F.col(id).alias("doc_id"), as_text(text).alias("text")).select(
        "doc_id",
        F.char_length("text").alias("size"),
        without_spaces(F.col("text")).alias("bare"),
    )
    fingerprint = F.xxhash64("bare").alias("fingerprint")
    rows = kept.keep(
        texts.select("doc_id", "size", fingerprint, F.sha2("bare", 256).alias("text_sha256")),
        "fingerprints",
    )
    repeated = kept.keep(repeated_fingerprints(rows.select("fingerprint")), "repeated")

    # The rows behind repeated fingerprints, by the bytes of their texts. The key is not the
    # join's key itself, so groups form in each task before anything is shuffled by text.
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id"))
    groups = (
        texts.select("doc_id", "size", "bare", fingerprint)
        .join(repeated.select("fingerprint"), "fingerprint", "left_semi")
        .groupBy(F.bitwise_not("fingerprint").alias("other"), "bare")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
        .filter("group_size > 1")
        .select(
            F.bitwise_not("other").alias("fingerprint"),
            F.sha2("bare", 256).alias("text_sha256"),
            "group_size",
            F.col("first.keep_id").alias("keep_id"),
            F.lit(True).alias("grouped"),
        )
    )
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return (
        rows.join(groups, ["fingerprint", "text_sha256"], "left")
        .withColumn("keep_id", keep_id)
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )
