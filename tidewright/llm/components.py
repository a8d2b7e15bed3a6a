"""Connected components of a graph of bounded degree, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then the label of
    that label, so paths shorten by halves. Labels only fall, and they stand still when
    every edge joins equal labels. Edges stay as they are: no node gains neighbours.
    Nothing but the number of changed labels comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = hooked.join(above, "root").select("node", "was", F.least("root", "higher").alias("root"))
        step = materialize(jumped, "labels")
        changed = step.filter("root <> was").limit(1).count()
        labels = step.select("node", "root")
        if not changed:
            return labels
