"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.operators.lineage import cut


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Rows node, root of the nodes in links (u, v): root is the least node of the component.

    Every node has a parent, itself at first, and parents only become smaller. In a round a node learns the least grandparent of its
    neighbours; it and its parent take that for a parent if it is smaller, and all nodes go over to their grandparents. So paths
    shrink to about half in a round, and the rounds grow with the logarithm of the longest chain. Every round is a few joins by node, checkpointed. Fails
    where `rounds` don't suffice.
    """
    edges = links.where("u != v").select("u", "v")
    edges = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parents = cut(links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("root", F.col("node")))
    for _ in range(rounds):
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
        grand = parents.join(above, "root").select("node", "root", "up")
        least = edges.join(grand.select(F.col("node").alias("v"), "up"), "v").groupBy("u").agg(F.min("up").alias("least"))
        known = cut(grand.join(least.withColumnRenamed("u", "node"), "node", "left"))
        offers = known.select("node", F.least("root", "up", "least").alias("root")).unionByName(known.where("least is not null").select(F.col("root").alias("node"), F.col("least").alias("root")))
        new = cut(offers.groupBy("node").agg(F.min("root").alias("root")))
        same = new.join(parents.withColumnRenamed("root", "before"), "node").where("root != before").isEmpty()
        parents = new
        if same:
            return parents
    raise RuntimeError(f"components did not settle in {rounds} rounds")
