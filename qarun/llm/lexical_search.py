"""Ranked lexical search over impact vectors ordered by length, exact to the last integer."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from qarun.llm.common import Kept

# Terms of the items that one pass over the documents looks for: some 50 MB in each task.
BLOCK_TERMS = 200_000
# Vectors of neighbouring length that are pruned and filtered together.
BUCKET = 4096
# Heaviest coordinates of an item that bound a score.
FOCUS = 8
# Bounds are computed in doubles and widened by this, so that rounding prunes nothing.
SLACK = 1 + 1e-9

# Fixed value: terms are runs of ASCII letters and digits and of all characters beyond ASCII;
# A-Z count as a-z.
_TERM_BYTES = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20
    for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document: its length in terms, and number and count of each term that items have."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            lengths, terms, counts = [], [], []
            for value in part.column(1):
                words = terms_of(value.as_py() or b"")
                own = sorted((numbers[w], n) for w, n in Counter(words).items() if w in numbers)
                lengths.append(len(words))
                terms.append([term for term, _ in own])
                counts.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return offsets - offsets[0], values


def _weighted(
    batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int
) -> Iterator[pa.RecordBatch]:
    """Per document: the length of its vector and the saturated count of each of its terms.

    A coordinate is the count times the root of the term's weight, as on the items' side.
    """
    for batch in batches:
        offsets, terms = _flat(batch.column(2))
        counts = _flat(batch.column(3))[1].astype(np.int64)
        m = 25 + (75 * batch.column(1).to_numpy() * documents) // total
        m = np.repeat(m, np.diff(offsets))
        parts = (1_000_000_000 * counts) // (1000 * counts + 8 * m)
        squares = np.r_[0.0, np.cumsum(weights[terms] * parts.astype(np.float64) ** 2)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.sqrt(np.maximum(squares[offsets[1:]] - squares[offsets[:-1]], 0))),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(terms)),
                pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(parts.astype(np.int32))
                ),
            ],
            names=["doc_id", "norm", "terms", "parts"],
        )


class _Item(NamedTuple):
    """An item as a vector: terms by falling weight, and what they count for in a score."""

    terms: np.ndarray
    times: np.ndarray  # weight times occurrences, whole numbers
    roots: np.ndarray  # coordinates
    norm: float
    rest: float  # length of the vector beyond its focus


def _item(terms: list[int], occurrences: list[int], weights: np.ndarray) -> _Item:
    terms, occurrences = np.array(terms, np.int64), np.array(occurrences, np.int64)
    order = np.argsort(-weights[terms], kind="stable")
    terms, occurrences = terms[order], occurrences[order]
    roots = occurrences * np.sqrt(weights[terms])
    return _Item(
        terms,
        occurrences * weights[terms],
        roots,
        float(np.sqrt((roots**2).sum())),
        float(np.sqrt((roots[FOCUS:] ** 2).sum())),
    )


class _Bucket:
    """Vectors of neighbouring length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        self.ids = batch.column(0)
        self.norms = batch.column(1).to_numpy()
        self.offsets, self.terms = _flat(batch.column(2))
        self.parts = _flat(batch.column(3))[1].astype(np.int64)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(self.offsets))
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.terms[order]
        self.rows, self.own = rows[order], self.parts[order]
        self.roots = np.sqrt(weights)

    def bounds(self, item: _Item) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the score of the item's focus, and a bound of the whole score.

        The rest of the score is at most the product of what is left of both lengths.
        """
        score = np.zeros(len(self.norms))
        squares = self.norms**2
        for term, root in zip(item.terms[:FOCUS], item.roots, strict=False):
            low, high = np.searchsorted(self.by_term, (term, term + 1))
            rows, values = self.rows[low:high], self.own[low:high] * self.roots[term]
            score[rows] += root * values
            squares[rows] -= values**2
        # A difference of squares has the error of the whole, not of what is left.
        left = np.sqrt(np.maximum(squares, 0) + 1e-9 * self.norms**2)
        return score, (score + item.rest * left) * SLACK

    def scores(self, item: _Item, rows: np.ndarray) -> np.ndarray:
        """Whole-number scores of the vectors ``rows``."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - ends + sizes, sizes)
        terms = self.terms[places]
        by_term = np.argsort(item.terms)
        known = item.terms[by_term]
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        times = np.where(known[at] == terms, item.times[by_term][at], 0)
        sums = np.r_[0, np.cumsum(times * self.parts[places])]
        return sums[ends] - sums[ends - sizes]


def _id_order(doc_id: object) -> tuple:
    return (doc_id is None, 0 if doc_id is None else doc_id)


def _searched(
    batches: Iterator[pa.RecordBatch],
    items: list[_Item],
    weights: np.ndarray,
    least: np.ndarray,
    k: int,
    seed: bool,
) -> Iterator[pa.RecordBatch]:
    """The ``k`` best vectors of this task for each item, of those that can reach ``least``.

    A task reads vectors by falling length. As a seed, only the ``k`` best of each bucket
    by the item's focus are scored: enough for a first lower bound.
    """
    best: list[list[tuple]] = [[] for _ in items]
    least = least.copy()
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for low in range(0, batch.num_rows, BUCKET):
            bucket = _Bucket(batch.slice(low, BUCKET), weights)
            longest = bucket.norms.max(initial=0)
            for i, item in enumerate(items):
                if longest * item.norm * SLACK < least[i]:  # Cauchy-Schwarz, for all of them
                    continue
                focus, bound = bucket.bounds(item)
                bound = np.minimum(bound, bucket.norms * (item.norm * SLACK))
                rows = np.flatnonzero(bound >= least[i])
                if seed and len(rows) > k:
                    rows = rows[np.argpartition(-focus[rows], k)[:k]]
                if not len(rows):
                    continue
                score = bucket.scores(item, rows)
                reached = score >= least[i]
                rows, score = rows[reached], score[reached]
                if not len(rows):
                    continue
                if len(rows) > k:  # ties stay until ids are compared
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[score >= cut], score[score >= cut]
                ids = bucket.ids.take(pa.array(rows)).to_pylist()
                best[i] += zip((-score).tolist(), map(_id_order, ids), ids, strict=True)
                best[i] = sorted(best[i])[:k]
                if len(best[i]) == k:
                    least[i] = max(least[i], -best[i][-1][0])
    found = [(i, -score, doc_id) for i, rows in enumerate(best) for score, _, doc_id in rows]
    if found:
        numbers, scores, ids = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(scores, pa.int64()), pa.array(ids, kind)],
            names=["item", "score", "doc_id"],
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per item; Spark keeps ``k`` of each part before the shuffle."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents for each item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z.
    With N documents that have a term, L terms in all and df documents with a term, its
    weight w is floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms has
    m = 25 + (75 * n * N) div L and scores, over the item's terms with repeats, the sum of
    w * ((10**9 * tf) div (1000 * tf + 8 * m)). Only scores above 0 are ranked; of equal
    scores the smaller ``doc_id`` comes first, a null one last.

    Null and empty texts have no terms: as documents they are not found, as items they find
    nothing. Rows of documents that share an id are ranked each on its own. Items that
    repeat id and text are one; the same id with other texts gives a ranking for each. Empty
    tables give no rows; other columns are not read; long texts are read whole.

    Documents become vectors over the terms that items have. They are put in order of length
    and read in buckets: one whose longest vector times the item's length cannot reach the
    item's k-th best score so far is skipped (Cauchy-Schwarz), and inside a bucket the item's
    heaviest coordinates bound each score. What is left is scored in whole numbers. A
    first look at the best of each bucket by those coordinates gives every task a bound
    to start with.

    Items with more than ``block_terms`` terms in all are cut into blocks, each one more pass.
    Only term numbers, counts and ids are shuffled, each document once a block.
    """
    spark = docs.sparkSession
    kept = Kept(spark)
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    asked = kept.keep(
        items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        .filter(F.octet_length("text") > 0)
        .distinct(),
        "items",
    )
    # Terms have two bytes at least, but for those of one letter.
    size = asked.agg(F.sum(F.ceil(F.octet_length("text") / 2))).first()[0] or 0
    blocks = max(1, -(-size // block_terms))
    totals = None
    found = []
    for block in range(blocks):
        # A block has some `block_terms` terms, the only rows of a table that the driver holds.
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        counts = [Counter(terms_of(row.text.encode())) for row in rows]
        numbers = {term: i for i, term in enumerate(sorted(set().union(*counts)))}
        if not numbers:
            continue
        vectors = kept.keep(
            texts.mapInArrow(
                lambda batches, numbers=numbers: _counted(batches, numbers),
                T.StructType(
                    [
                        texts.schema["doc_id"],
                        *T.StructType.fromDDL(
                            "n bigint, terms array<int>, counts array<int>"
                        ).fields,
                    ]
                ),
            ),
            "term-counts",
        )
        if totals is None:
            totals = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, total = totals
        if not total:
            break
        df = np.zeros(len(numbers), np.int64)
        # One row per term of the block.
        for term, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = n
        weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()],
            np.int64,
        )
        wanted = [
            _item([numbers[t] for t in own], list(own.values()), weights) for own in counts
        ]
        table = T.StructType(
            [
                texts.schema["doc_id"],
                *T.StructType.fromDDL("norm double, terms array<int>, parts array<int>").fields,
            ]
        )
        by_length = kept.keep(
            vectors.filter(F.size("terms") > 0)
            .mapInArrow(
                lambda batches, w=weights, n=documents, m=total: _weighted(batches, w, n, m), table
            )
            .filter(F.col("norm") > 0)
            # Equal lengths, as of copies, may lie in several parts.
            .repartitionByRange(F.desc("norm"), F.xxhash64("doc_id", F.size("terms")))
            .sortWithinPartitions(F.desc("norm")),
            "impact-vectors",
        )
        kept.drop([vectors])
        hit = T.StructType(
            [*T.StructType.fromDDL("item int, score bigint").fields, texts.schema["doc_id"]]
        )

        def look(least: np.ndarray, seed: bool, table=by_length, q=wanted, w=weights, hit=hit):
            return table.mapInArrow(lambda b: _searched(b, q, w, least, k, seed), hit)

        least = np.ones(len(wanted), np.int64)  # scores of 0 are not ranked
        seeds = _ranked(look(least, True), k).filter(F.col("rank") == k)
        for row in seeds.select("item", "score").collect():  # one row per item of the block
            least[row.item] = row.score
        names = spark.createDataFrame(
            pa.table(
                {
                    "item": pa.array(range(len(rows)), pa.int32()),
                    "item_id": pa.array([row.item_id for row in rows]),
                }
            )
        ).select("item", F.col("item_id").cast(asked.schema["item_id"].dataType))
        best = _ranked(look(least, False), k).join(F.broadcast(names), "item")
        found.append(best.select("item_id", "rank", "doc_id", "score"))
    if found:
        return reduce(DataFrame.unionByName, found)
    empty = T.StructType(
        [
            asked.schema["item_id"],
            T.StructField("rank", T.IntegerType()),
            texts.schema["doc_id"],
            T.StructField("score", T.LongType()),
        ]
    )
    return spark.createDataFrame([], empty)
