"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component``: the smallest node (long) that edges ``a, b`` reach, for the nodes of edges.

    Smallest labels pass along edges and then along labels, which halves the
    way left in each round; every round is written, so that neither lineage
    nor a lost executor costs earlier rounds. Labels only get smaller, so the
    rounds end. No edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        far = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        passed = labels.join(far, F.col("node") == F.col("a")).select("node", F.col("component").alias("before"), F.least("component", "near").alias("hop"))
        ahead = labels.select(F.col("node").alias("hop_node"), F.col("component").alias("ahead"))
        new = passed.join(ahead, F.col("hop") == F.col("hop_node"), "left").select("node", F.least("hop", F.coalesce("ahead", "hop")).alias("component"), "before")
        new = scratch.write(new, f"{name}-{turn}")
        changed = new.where("component <> before").limit(1).count()
        labels = new.select("node", "component")
        scratch.drop(f"{name}-{turn - 1}")
        if not changed:
            return labels
