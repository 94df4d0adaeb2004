"""Nearest neighbours by cross-polytope hashing with several probes, reranked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from qarun.llm.common import Kept, lent

# Tables, each with hash functions of its own; every vector is in each of them once.
TABLES = 3
# Vectors that a bucket holds on average at most; beyond it a key gets one more axis.
FULL = 8192
# Vectors and queries on the two sides of a block of a large bucket.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
# Queries that the number of probes is fitted on, and the share of their neighbours to be found.
SAMPLE, RECALL = 256, 0.95
# Axis combinations that a query's probes are chosen from.
CHOICE = 1 << 16


@lru_cache
def _signs(dim: int, table: int, axes: int) -> np.ndarray:
    """Random signs of the rounds of each pseudo-rotation of a table."""
    width = 1 << max(dim - 1, 1).bit_length()
    random = np.random.default_rng((dim, table))
    return random.integers(0, 2, (axes, 3, width)).astype(np.float64) * 2 - 1


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, without scale."""
    n, width = rows.shape
    step = 1
    while step < width:
        halves = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], 2)
        rows = rows.reshape(n, width)
        step *= 2
    return rows


def rotated(rows: np.ndarray, table: int, axes: int) -> np.ndarray:
    """Each unit vector after ``axes`` pseudo-rotations, with its signed axes side by side.

    A rotation is three rounds of random signs and a Hadamard transform. Value j is the
    coordinate along axis j, and value j + width that along the opposite one.
    """
    dim = rows.shape[1]
    signs = _signs(dim, table, axes)
    width = signs.shape[2]
    unit = np.zeros((len(rows), width))
    scale = np.abs(rows).max(axis=1, keepdims=True)  # no length overflows
    unit[:, :dim] = rows / scale
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    out = np.empty((len(rows), axes, 2 * width))
    for a in range(axes):
        turned = unit
        for round_ in range(3):
            turned = _hadamard(turned * signs[a, round_]) / math.sqrt(width)
        out[:, a, :width], out[:, a, width:] = turned, -turned
    return out


def keys_of(rows: np.ndarray, table: int, axes: int) -> np.ndarray:
    """The bucket of each vector: its nearest signed axis after each rotation."""
    near = rotated(rows, table, axes)
    key = np.zeros(len(rows), np.int64)
    for a in range(axes):
        key = key * near.shape[2] + near[:, a].argmax(axis=1)
    return key


def probes_of(rows: np.ndarray, table: int, axes: int, most: int) -> list[np.ndarray]:
    """Buckets of each query, likeliest first: by the sum of coordinates along their axes."""
    near = rotated(rows, table, axes)
    width = near.shape[2]
    some = min(width, int(CHOICE ** (1 / axes)))
    out = []
    for row in near:
        total, key = np.zeros(1), np.zeros(1, np.int64)
        for a in range(axes):
            top = np.argsort(-row[a], kind="stable")[:some]
            total = (total[:, None] + row[a][top]).ravel()
            key = (key[:, None] * width + top).ravel()
        out.append(key[np.argsort(-total, kind="stable")[:most]])
    return out


class Plan(NamedTuple):
    """How many axes a key has and how many buckets a query looks into, per dimension."""

    axes: dict[int, int]
    probes: dict[int, int]


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(lengths == dim)))


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """For each query the places of its ``k`` nearest rows and their exact distances, in order.

    One product of matrices tells which rows may be among them; those are measured exactly.
    """
    squares = (rows**2).sum(axis=1)
    for low in range(0, len(queries), 256):
        part = queries[low : low + 256]
        own = (part**2).sum(axis=1)
        rough = own[:, None] + squares - 2 * (part @ rows.T)
        finite = np.isfinite(rough).all()
        error = 1e-12 * (own + squares.max(initial=0))
        for i, query in enumerate(part):
            if len(rows) > k and finite:
                cut = np.partition(rough[i], k - 1)[k - 1]
                some = np.flatnonzero(rough[i] <= cut + error[i])
            else:
                some = np.arange(len(rows))
            exact = distances(query, rows[some])
            order = np.lexsort((ids[some], exact))[:k]
            yield some[order], exact[order]


def _valid(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id, v, h`` of the rows that take part; rows that repeat both are one."""
    numbers = F.col(vector)
    whole = F.forall(
        numbers,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    some = F.exists(numbers, lambda x: x != 0)
    return rows.filter(F.col(id).isNotNull() & numbers.isNotNull() & whole & some).select(
        F.col(id).alias("vec_id"), numbers.alias("v"), F.xxhash64(vector).alias("h")
    )


def _few_copies(vectors: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` rows with the smallest ids of each group of equal vectors.

    No query needs more of them. Only groups with more rows are shuffled, and each part of
    one is cut to as many rows before.
    """
    hot = lent(vectors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1))
    hot = hot.select("h")
    own = Window.partitionBy("h", "v").orderBy("vec_id")
    folded = (
        vectors.join(hot, "h", "left_semi")
        .withColumn("place", F.row_number().over(own))
        .filter(F.col("place") <= k + 1)
        .drop("place")
    )
    return vectors.join(hot, "h", "left_anti").select(*folded.columns).unionByName(folded)


def fitted(candidates: DataFrame, queries: DataFrame, k: int, full: int = FULL) -> Plan:
    """The least number of probes that finds ``RECALL`` of the neighbours of ``SAMPLE`` queries.

    Their true neighbours come from one exact look at all candidates. Where many axes
    miss too much, a key gets fewer, down to one, where all buckets can be probed.
    """
    sizes = candidates.groupBy(F.size("v").alias("dim")).count().collect()  # a row per length
    axes, probes = {}, {}
    for dim, n in sizes:
        sample = (
            queries.filter(F.size("v") == dim)
            .orderBy(F.xxhash64("h", F.lit("sample")), "vec_id")
            .limit(SAMPLE)
            .collect()
        )
        if not sample:
            continue
        asked = np.array([row.v for row in sample], np.float64)
        own = np.array([row.vec_id for row in sample])

        def look(batches, asked=asked, own=own, dim=dim):
            for batch in batches:
                for found, part in _by_dim(batch, 1):
                    if found != dim:
                        continue
                    rows, ids = _vectors(part.column(1)), part.column(0).to_numpy()
                    out = [(i, p, d) for i, (at, far) in enumerate(nearest(asked, rows, ids, k + 1))
                           for p, d in zip(at.tolist(), far.tolist(), strict=True)
                           if ids[p] != own[i]]
                    if out:
                        number, at, far = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number, pa.int32()), part.column(0).take(pa.array(at)),
                             part.column(1).take(pa.array(at)), pa.array(far, pa.float64())],
                            names=["query", "vec_id", "v", "score"],
                        )

        kind = candidates.schema
        near = candidates.select("vec_id", "v").mapInArrow(
            look,
            T.StructType([T.StructField("query", T.IntegerType()), kind["vec_id"], kind["v"],
                          T.StructField("score", T.DoubleType())]),
        )
        place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        truth = near.withColumn("place", place).filter(F.col("place") <= k).collect()
        if not truth:
            axes[dim], probes[dim] = 1, 1
            continue
        rows = np.array([row.v for row in truth], np.float64)
        of = np.array([row.query for row in truth])
        width = 2 << max(dim - 1, 1).bit_length()
        many = max(1, math.ceil(math.log(max(n / full, 1)) / math.log(width)))
        for number in range(many, 0, -1):
            # The first probe of any table that holds the neighbour.
            first = np.full(len(rows), np.iinfo(np.int64).max)
            for table in range(TABLES):
                key = keys_of(rows, table, number)
                for i, tried in enumerate(probes_of(asked, table, number, CHOICE)):
                    mine = np.flatnonzero(of == i)
                    order = np.argsort(tried)
                    at = np.minimum(np.searchsorted(tried[order], key[mine]), len(tried) - 1)
                    hit = tried[order][at] == key[mine]
                    first[mine[hit]] = np.minimum(first[mine[hit]], order[at][hit])
            needed = np.sort(first)[math.ceil(RECALL * len(first)) - 1]
            if needed < CHOICE:
                axes[dim], probes[dim] = number, int(needed) + 1
                break
    return Plan(axes, probes)


def _entries(
    batches: Iterator[pa.RecordBatch], plan: Plan, query: bool, counted: bool
) -> Iterator[pa.RecordBatch]:
    """Each vector in its bucket of every table, or each query in the buckets it probes."""
    for batch in batches:
        for dim, part in _by_dim(batch, 1):
            if dim not in plan.axes:
                continue
            rows = _vectors(part.column(1))
            for table in range(TABLES):
                if query:
                    tried = probes_of(rows, table, plan.axes[dim], plan.probes[dim])
                    at = np.repeat(np.arange(len(rows)), [len(one) for one in tried])
                    key = np.concatenate(tried)
                else:
                    at, key = np.arange(len(rows)), keys_of(rows, table, plan.axes[dim])
                for low in range(0, len(at), 10_000):
                    some = pa.array(at[low : low + 10_000])
                    bucket = [
                        pa.array(np.full(len(some), dim * TABLES + table, np.int64)),
                        pa.array(key[low : low + 10_000]),
                    ]
                    own = [] if counted else [column.take(some) for column in part.columns]
                    yield pa.RecordBatch.from_arrays(
                        [*bucket, *own],
                        names=["of", "key", *([] if counted else part.schema.names)],
                    )


def _measured(block: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest rows of a block for each of its queries."""
    is_query = block.column("query").to_numpy(zero_copy_only=False)
    at, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    ids, out = block.column("vec_id").combine_chunks(), []
    if len(at) and len(asked):
        vectors = block.column("v").combine_chunks()
        rows, queries = (_vectors(vectors.take(pa.array(side))) for side in (at, asked))
        own = ids.to_numpy()[at]
        for i, (near, far) in enumerate(nearest(queries, rows, own, k)):
            out += [(asked[i], at[p], d) for p, d in zip(near, far, strict=True)]
    query, row, score = zip(*out, strict=True) if out else ((), (), ())
    return pa.table(
        {
            "asked": ids.take(pa.array(query, pa.int64())),
            "vec_id": ids.take(pa.array(row, pa.int64())),
            "score": pa.array(score, pa.float64()),
        }
    )


def search_vectors(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    full: int = FULL,
) -> DataFrame:
    """The ``k`` nearest candidates found for each query: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance of the original vectors in doubles; equal ones are put in
    order of ``vec_id``, a whole number. Both tables have the columns ``id`` and ``vector``. A
    query is no candidate of its own: rows with its id are left out. With fewer than ``k``
    candidates all those found are given.

    Rows with a null id and vectors that are null, zero, or hold a null or non-finite number
    take no part. Only vectors of the same length meet. Rows that repeat id and vector are one;
    an id with several vectors is a query with each of them. Empty tables give no rows, and
    other columns are not read.

    A key is the nearest signed axis after one or more fast pseudo-rotations of the unit vector;
    every candidate is filed once in each of ``TABLES`` tables, and a query looks into the buckets
    whose axes it comes closest to. Of equal vectors only the ``k`` + 1 with the smallest ids are
    filed, as no query needs more, and equal queries are asked once. A key has as many axes as it
    takes for ``full`` candidates per bucket, and the number of probes is the least that found
    ``RECALL`` of the neighbours of ``SAMPLE`` queries; their true neighbours come from
    one exact look at all candidates. A large bucket is cut into blocks of vectors and queries, each
    of which gives ``k`` rows per query and no pairs.
    """
    spark = candidates.sparkSession
    kept = Kept(spark)
    valid = _valid(candidates, id, vector)
    few = kept.keep(_few_copies(valid, k).distinct(), "vectors")
    every = kept.keep(_valid(queries, id, vector).distinct(), "queries")
    asked = kept.keep(
        every.groupBy("h", "v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v", "h"),
        "distinct-queries",
    )
    plan = fitted(few, asked, k, full)
    wide = T.StructType.fromDDL("of bigint, key bigint")

    def filed(rows: DataFrame, query: bool, counted: bool) -> DataFrame:
        rows = rows.select("vec_id", "v")
        return rows.mapInArrow(
            lambda batches: _entries(batches, plan, query, counted),
            wide if counted else T.StructType([*wide.fields, *rows.schema.fields]),
        )

    n = F.count(F.lit(1)).alias("n")
    held = filed(few, False, True).groupBy("of", "key").agg(n)
    wanted = filed(asked, True, True).groupBy("of", "key").agg(n)
    sizes = lent(
        held.withColumnRenamed("n", "m")
        .join(wanted, ["of", "key"])
        .select(
            "of",
            "key",
            F.ceil(F.col("n") / BLOCK_QUERIES).cast("int").alias("rows"),
            F.ceil(F.col("m") / BLOCK_VECTORS).cast("int").alias("columns"),
        )
    )
    spread = F.xxhash64("vec_id", "v")
    side = ["of", "key", "row", "column", "query", "vec_id", "v"]
    left = (
        filed(asked, True, False)
        .join(sizes, ["of", "key"])
        .withColumn("row", F.pmod(spread, "rows").cast("int"))
        .withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
        .withColumn("query", F.lit(True))
    )
    right = (
        filed(few, False, False)
        .join(sizes, ["of", "key"])
        .withColumn("column", F.pmod(spread, "columns").cast("int"))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        .withColumn("query", F.lit(False))
    )
    kind = few.schema["vec_id"].dataType
    near = (
        left.select(*side)
        .unionByName(right.select(*side))
        .groupBy("of", "key", "row", "column")
        .applyInArrow(
            lambda block: _measured(block, k + 1),
            T.StructType(
                [
                    T.StructField("asked", kind),
                    T.StructField("vec_id", kind),
                    T.StructField("score", T.DoubleType()),
                ]
            ),
        )
        # The rows of a query are at most k + 1 per block that it looks into.
        .groupBy("asked")
        .agg(F.array_sort(F.collect_set(F.struct("score", "vec_id"))).alias("near"))
        .select("asked", F.slice("near", 1, k + 1).alias("near"))
    )
    members = every.join(
        asked.select(F.col("vec_id").alias("asked"), F.col("h").alias("of_h"), F.col("v").alias("of_v")),
        (F.col("h") == F.col("of_h")) & (F.col("v") == F.col("of_v")),
    ).select(F.col("vec_id").alias("query_id"), "asked")
    others = F.filter("near", lambda one: one["vec_id"] != F.col("query_id"))
    return (
        members.join(near, "asked")
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "one"))
        .select("query_id", (F.col("place") + 1).alias("rank"), "one.vec_id", "one.score")
    )
