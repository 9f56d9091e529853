"""Connected components of an edge table, by least labels with shortcuts; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> DataFrame:
    """(node, component): for every node of an edge the smallest node it reaches.  Nulls and loops are left out; repeated edges don't matter.

    A round takes the least label among neighbours and then the label's own label, so paths shrink by more than half a round.
    Nothing is gathered: a round's only news for the driver is how many labels changed.
    """
    pairs = edges.select(F.col(a).cast(kind).alias("x"), F.col(b).cast(kind).alias("y")).filter("x <> y")
    both = cut(pairs.union(pairs.select(F.col("y"), F.col("x"))).distinct().toDF("x", "y"), "edges")
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")), "labels")
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("near"))
        least = labels.join(seen, F.col("node") == F.col("x")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        least = cut(least, "labels")
        own = least.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        after = least.join(own, F.col("component") == F.col("n2"), "left").select("node", "old", F.least("component", F.coalesce("c2", "component")).alias("component"))
        after = cut(after, "labels")
        drop(labels, least)
        if after.filter("component <> old").isEmpty():
            drop(both)
            return after.select("node", "component")
        labels = cut(after.select("node", "component"), "labels")
        drop(after)
