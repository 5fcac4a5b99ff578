"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every id in ``edges`` (a, b): the label is the smallest id of its component.

    Every round takes the smallest label among a vertex and its neighbours and then the label of that label,
    so labels travel over twice the distance each round. Minima are taken before rows are shuffled, and the
    labels of a hub are joined once per neighbour, with skew handling. Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        of = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        after = written(closer.join(of, "next").select("v", "label", F.least("next", "jump").alias("new")), "labels")
        labels = after.select("v", F.col("new").alias("label"))
        if after.filter("new < label").isEmpty():
            return labels
