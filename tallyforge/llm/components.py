"""Connected components of an edge table by hooking and pointer jumping; every step is a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_persisted, persist


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Each round hooks every node to its smallest neighbour if that is smaller, jumps to the roots of the trees this makes,
    and keeps the edges between different roots. Trees are contracted, so rounds grow with the logarithm of the nodes.
    """
    e = persist(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("next")))
        up = persist(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("up")), "cc-up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = persist(up.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-up")
            moved = not higher.where("moved").isEmpty()
            drop_persisted(up)
            up = higher
            if not moved:
                break
        roots = up.select("node", "up")
        if labels is None:
            merged = persist(roots.select("node", F.col("up").alias("comp")), "cc-labels")
        else:
            merged = persist(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "cc-labels")
            drop_persisted(labels)
        labels = merged
        a, b = roots.select(F.col("node").alias("a"), F.col("up").alias("ua")), roots.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = persist(e.join(a, "a").join(b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-edges")
        drop_persisted(e)
        drop_persisted(up)
        e = left
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
