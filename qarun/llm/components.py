"""Connected components of a graph that is too large for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qarun.llm.common import Kept


def components(edges: DataFrame, kept: Kept) -> DataFrame:
    """The smallest reachable node, ``component``, of every ``node`` that has an edge.

    ``edges`` has the columns ``a, b``. Every round each node takes the smallest label next
    to it and then the label of that label, so long chains shrink fast. Rounds are written
    to the shared folder; only whether a label changed comes back to the driver.
    """
    reverse = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    links = kept.keep(edges.select("a", "b").unionByName(reverse), "links")
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    labels = kept.keep(
        least.select("node", F.least("node", "b").alias("component")), "labels"
    )
    while True:
        near = (
            links.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a"))
            .agg(F.min("component").alias("near"))
        )
        stepped = kept.keep(
            labels.join(near, F.col("node") == F.col("a")).select(
                "node",
                F.col("component").alias("old"),
                F.least("component", "near").alias("component"),
            ),
            "labels",
        )
        heads = stepped.select(F.col("node").alias("head"), F.col("component").alias("beyond"))
        jumped = kept.keep(
            stepped.join(heads, F.col("component") == F.col("head")).select(
                "node", "old", F.least("component", "beyond").alias("component")
            ),
            "labels",
        )
        done = jumped.filter(F.col("old") != F.col("component")).isEmpty()
        kept.drop([labels, stepped])
        labels = jumped
        if done:
            kept.drop([links])
            return labels.select("node", "component")
