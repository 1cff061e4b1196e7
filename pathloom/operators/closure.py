"""Transitive closure over rows: `repeat` where the tree spans resources."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: After so many rounds what is found is written as one table.
GATHER = 50


def descend(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", root: str = "root") -> DataFrame:
    """root, node, depth of all that is reached from each root, each node once, at
    its least depth; the root itself isn't part of it unless a cycle leads back.
    Breadth first; each round joins only the frontier, and is written to the
    checkpoint folder, so the plan stays short and losses are survived."""
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pathloom-"))
    e = edges.select(F.col(parent).alias("p"), F.col(child).alias("node"))
    frontier = roots.select(F.col(root).alias("root"), F.col(root).alias("at")).distinct()
    found = None
    for depth in count(1):
        step = frontier.join(e, frontier["at"] == e["p"]).select("root", "node").distinct()
        if found is not None:
            step = step.join(found.select("root", "node"), ["root", "node"], "left_anti")
        step = step.withColumn("depth", F.lit(depth)).checkpoint()
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        if depth % GATHER == 0:
            found = found.coalesce(spark.sparkContext.defaultParallelism).checkpoint()
        frontier = step.select("root", F.col("node").alias("at"))
    return found if found is not None else step
