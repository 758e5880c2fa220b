"""Connected components by minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (id, component), component being the smallest id reachable.

    Each round a node takes the least label of itself and its neighbours, then its
    label's label, so long chains take a logarithmic number of rounds. Labels are
    written to the shared folder each round. Nodes with very many neighbours and labels
    that very many nodes carry are joined by broadcast (spread_join). Ids without an edge
    are not returned.
    """
    both = common.materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.count("*").alias("_degree"))
    labels = common.materialize(labels.select("id", F.least("id", "m").alias("label"), "_degree"), "cc")
    ends = both.select("a", F.col("b").alias("id"))
    while True:
        near = common.spread_join(ends, labels, "id", "_degree").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"), "_degree")
        taken = common.materialize(taken, "cc-taken")
        held = taken.groupBy("label").agg(F.count("*").alias("_held"))
        jumps = common.materialize(held.join(taken.select(F.col("id").alias("label"), F.col("label").alias("_jump")), "label"), "cc-jumps")
        new = common.spread_join(taken, jumps, "label", "_held").select("id", "was", F.least("label", "_jump").alias("label"), "_degree")
        new = common.materialize(new, "cc")
        labels = new.select("id", "label", "_degree")
        if not new.where("label <> was").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
