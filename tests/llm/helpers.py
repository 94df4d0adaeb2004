"""Small tables with the awkward cases every operator has to take."""

import hashlib

from pyspark.sql import types as T

# Extra columns carry names that operators use inside.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("gone", T.LongType()),
        T.StructField("component_id", T.LongType()),
        T.StructField("n_lines", T.LongType()),
    ]
)


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "r", None, 7, None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))
