"""Connected components by hooking to the smallest neighbour, pointer jumping and contraction; all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), of one type with an order; root is the smallest node of its component.

    Null ends and loops are ignored. Each round at least halves the nodes that still have edges, so the rounds are
    logarithmic; every round is written to the shared folder.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = written(edges.where("a is not null and b is not null and a <> b").select(a, b).distinct(), "edges")
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks")
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            far = written(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jumps")
            up = far.select("node", "up")
            if far.where("moved").isEmpty():
                break
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = left.join(to_a, "a").join(to_b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        left = written(left, "edges")
        if label is None:
            label = up.select("node", F.col("up").alias("root"))
        else:
            label = label.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
