"""MinHash near-dedup with tensored banding, confirmed on whole shingle sets."""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qarun.llm.common import Kept
from qarun.llm.components import components
from qarun.llm.shingles import minima, mixed, shingle_set

# Minima in one half of a table key; a whole key is a pair of halves.
HALF = 2
# How often two documents right at the threshold may share no table.
MISS = 1e-4
# Ids that are broadcast at most (some 50 MB); beyond it they are joined by key.
MAX_BROADCAST_IDS = 500_000
# Members up to which all of a bucket's pairs are looked at.
SMALL_BUCKET = 8
# Documents on either side of a block of a large family.
BLOCK = 512


def halves_for(threshold: float) -> int:
    """Halves in a collection, so that pairs of them find a link but for ``MISS``.

    A half agrees with chance threshold**HALF, and both collections need one that does.
    """
    return math.ceil(math.log(MISS / 2) / math.log(1 - threshold**HALF))


def _signed(batches: Iterator[pa.RecordBatch], words: int, n: int) -> Iterator[pa.RecordBatch]:
    """Per document: size, fingerprints and minima (null if empty) of its set."""
    for batch in batches:
        sizes, prints, signs = [], [], []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py(), words)
            sizes.append(len(shingles))
            twice = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
            prints.append((shingles.sum(dtype=np.uint64), twice.sum(dtype=np.uint64)))
            least = (minima(shingles, n) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            signs.append(least if len(shingles) else None)
        both = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(both[:, 0]),
                pa.array(both[:, 1]),
                pa.array(signs, pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_shingles", "f1", "f2", "minima"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py(), words).view(np.int64) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"]
        )


def _linked(block: pa.Table, percent: int) -> pa.Table:
    """Similar pairs of a query and a target with different labels, one per query and label."""
    is_query = block.column("query").to_numpy(zero_copy_only=False)
    reps, labels = block.column("rep").combine_chunks(), block.column("label").to_pylist()
    sets = block.column("shingles").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    targets = np.flatnonzero(~is_query & (sizes > 0))
    pairs = []
    if len(targets):
        flat = np.concatenate([sets[int(i)].values.to_numpy().view(np.uint64) for i in targets])
        starts = np.r_[0, np.cumsum(sizes[targets])[:-1]]
        for i in np.flatnonzero(is_query):
            own = sets[int(i)].values.to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
            union = sizes[i] + sizes[targets] - shared
            reached = {labels[t]: t for t in targets[100 * shared >= percent * union]}
            pairs += [(i, t) for label, t in reached.items() if label != labels[i]]
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    first, second = (reps.take(pa.array(side, pa.int64())) for side in (a, b))
    return pa.table({"a": first, "b": second})


def _named(schema: T.StructType, *more: str) -> T.StructType:
    """The type of ``doc_id`` from ``schema`` and further columns."""
    return T.StructType([schema["doc_id"], *T.StructType.fromDDL(", ".join(more)).fields])


class _Search:
    """Links between the classes of one table of documents."""

    def __init__(
        self,
        texts: DataFrame,
        classes: DataFrame,
        words: int,
        threshold: float,
        n: int,
        kept: Kept,
    ):
        self.texts, self.classes, self.words, self.kept = texts, classes, words, kept
        self.percent = round(100 * threshold)
        # Six standard deviations below what a pair at the threshold agrees on.
        spread = math.sqrt(n * threshold * (1 - threshold))
        self.least_agreeing = math.floor(n * threshold - 6 * spread)
        self.sets: DataFrame | None = None

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Shingle sets of at least the documents ``doc_id``, each set made once."""
        ids = ids.distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = self.kept.keep(ids, "ids")
        n = ids.count()
        if n or self.sets is None:
            wanted = F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids
            fresh = self.kept.keep(
                self.texts.join(wanted, "doc_id", "left_semi").mapInArrow(
                    lambda batches, words=self.words: _sets(batches, words),
                    _named(self.texts.schema, "shingles array<bigint>"),
                ),
                "shingle-sets",
            )
            self.sets = fresh if self.sets is None else self.sets.unionByName(fresh)
        return self.sets

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose whole sets are similar enough."""
        side = self.classes.select("rep", "minima")
        agreeing = F.size(F.filter(F.zip_with("m1", "m2", lambda x, y: x == y), lambda same: same))
        likely = self.kept.keep(
            pairs.join(side.toDF("a", "m1"), "a")
            .join(side.toDF("b", "m2"), "b")
            .filter(agreeing >= self.least_agreeing)
            .select("a", "b")
            .distinct(),
            "likely-pairs",
        )
        self.fetch(likely.select(F.explode(F.array("a", "b")).alias("doc_id")))
        shared = F.size(F.array_intersect("s1", "s2"))
        union = F.size("s1") + F.size("s2") - shared
        return self.kept.keep(
            likely.join(self.sets.toDF("a", "s1"), "a")
            .join(self.sets.toDF("b", "s2"), "b")
            .filter(100 * shared >= self.percent * union)
            .select("a", "b"),
            "similar-pairs",
        )

    def within(self, families: DataFrame) -> DataFrame:
        """Links of the rows marked ``query`` to rows of their ``family`` with another label.

        Both sides are cut into blocks of some ``BLOCK`` rows; a task holds one of each.
        """
        sizes = families.groupBy("family").agg(
            F.ceil(F.count_if("query") / BLOCK).cast("int").alias("rows"),
            F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("columns"),
        )
        sets = self.fetch(families.select(F.col("rep").alias("doc_id")))
        placed = (
            families.join(sizes.filter("rows > 0"), "family")
            .join(sets.withColumnRenamed("doc_id", "rep"), "rep")
            .withColumn("spread", F.xxhash64("rep"))
        )
        own = {"row": F.pmod("spread", "rows"), "column": F.pmod("spread", "columns")}
        side = ["family", "row", "column", "rep", "label", "query", "shingles"]
        queries = (
            placed.filter("query")
            .withColumn("row", own["row"].cast("int"))
            .withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
        )
        targets = (
            placed.withColumn("column", own["column"].cast("int"))
            .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
            .withColumn("query", F.lit(False))
        )
        percent, kind = self.percent, self.texts.schema["doc_id"].dataType
        return self.kept.keep(
            queries.select(*side)
            .unionByName(targets.select(*side))
            .groupBy("family", "row", "column")
            .applyInArrow(
                lambda block: _linked(block, percent),
                T.StructType([T.StructField("a", kind), T.StructField("b", kind)]),
            )
            .distinct(),
            "similar-pairs",
        )


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``threshold`` (taken in whole per cent); ``component_id`` is the
    smallest id that links lead to and ``kept`` tells whether it is the row's own.

    Null, empty and blank texts have an empty set and no link. A text with fewer words has its
    whole sequence as one shingle. Rows that share an id are one document: they are in one
    component. A row with a null id is linked with nothing: its ``component_id`` is null and it
    is kept. An empty table gives no rows; other columns are not read. Long texts are read whole.

    Documents with the same set form a class, and only classes are searched. The key of a
    table is a pair of half keys, one from each of two collections, so m halves on each side
    give m * m tables from the minima of 2 * m halves. A link is confirmed on the whole sets,
    after a look at the minima.

    First the members of a bucket meet its center, the one that shares the most buckets.
    Buckets whose members are then in one component are done. Of the others, small ones
    look at all their pairs of different components. Large ones with the same center form a
    family, in which only the documents that are not yet linked with the center are compared
    with the rest, block by block; a block gives its links, never its pairs.
    """
    kept = Kept(docs.sparkSession)
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    m = halves_for(threshold)
    n = 2 * m * HALF
    rows = kept.keep(
        texts.mapInArrow(
            lambda batches: _signed(batches, words, n),
            _named(
                texts.schema,
                "n_shingles bigint, f1 bigint, f2 bigint, minima array<int>",
            ),
        ),
        "minima",
    )
    linkable = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = kept.keep(
        linkable.groupBy("f1", "f2", "n_shingles").agg(
            F.min("doc_id").alias("rep"),
            F.any_value("minima").alias("minima"),
        ),
        "classes",
    )
    of_class = linkable.select("doc_id", "f1", "f2", "n_shingles").join(
        classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]
    )
    membership = kept.keep(of_class.select("doc_id", "rep").distinct(), "membership")
    # Rows that share an id but not a set.
    first = membership.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most"))
    edges = [
        membership.join(first.filter(F.col("a") != F.col("most")), "doc_id")
        .filter(F.col("rep") != F.col("a"))
        .select("a", F.col("rep").alias("b"))
    ]

    def half(i: int) -> list[Column]:
        return [F.get("minima", F.lit(HALF * i + at)) for at in range(HALF)]

    keys = F.array(
        *[
            F.xxhash64(F.lit(i * m + j), *half(i), *half(m + j))
            for i in range(m)
            for j in range(m)
        ]
    )
    entries = classes.select("rep", F.explode(keys).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = kept.keep(entries.join(shared, "key"), "shared-buckets")
    # What many others look like, such as the original of many edited copies, shares the
    # largest buckets and is the best center.
    weight = entries.groupBy("rep").agg(F.sum("n").alias("weight"))
    heaviest = F.max(F.struct("weight", F.xxhash64("rep").alias("h"), "rep")).getField("rep")
    members = entries.select("key", "rep").join(weight, "rep")
    met = kept.keep(
        members.join(members.groupBy("key").agg(heaviest.alias("center")), "key")
        .filter(F.col("rep") != F.col("center"))
        .select("key", "rep", "center"),
        "met-centers",
    )
    search = _Search(texts, classes, words, threshold, n, kept)
    pair = [F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")]
    edges.append(search.confirmed(met.select(*pair).distinct()))
    labels = components(edges[0].unionByName(edges[1]), kept)

    # A bucket whose other members are in one component has no more to tell.
    left = met.join(labels.toDF("rep", "of_rep"), "rep", "left").select(
        "key", "rep", "center", F.coalesce("of_rep", F.col("rep")).alias("label")
    )
    mixed_buckets = (
        left.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l1"), F.max("label").alias("l2"))
        .filter(F.col("l1") != F.col("l2"))
        .select("key", "n")
    )
    left = kept.keep(left.join(mixed_buckets, "key"), "mixed-buckets")
    small = left.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select("key", F.col("rep").alias("b"), F.col("label").alias("of_b"))
    pairs = small.join(other, "key").filter(
        (F.col("rep") < F.col("b")) & (F.col("label") != F.col("of_b"))
    )
    edges.append(search.confirmed(pairs.select(F.col("rep").alias("a"), "b").distinct()))

    # Large buckets with the same center hold much the same documents: they are one family.
    families = (
        left.filter(F.col("n") > SMALL_BUCKET)
        .select(F.col("center").alias("family"), "rep", "label")
        .distinct()
        .join(labels.toDF("family", "of_family"), "family", "left")
        .withColumn("query", F.col("label") != F.coalesce("of_family", F.col("family")))
    )
    edges.append(search.within(kept.keep(families, "families")))
    labels = components(reduce(DataFrame.unionByName, edges), kept)
    component = (
        membership.join(labels, F.col("rep") == F.col("node"), "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    lone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles")
        .join(component, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", lone).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
