"""Connected components as joins and aggregates; edges and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.session import settle

ONE_TASK_EDGES = 200_000     # counted; graphs with more edges are shuffled


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each round every label that has a smaller neighbour hooks onto its
    smallest one, the forest is flattened by pointer jumping, and the edges
    are contracted to the roots of its trees; it ends when no edge is left.
    Chains close in a logarithmic number of steps.

    Nulls at either end drop the edge; loops and repeated edges do no harm; an
    empty edge table gives an empty result.
    """
    ends = settle(edges.select(F.col(left).alias("_u"), F.col(right).alias("_v")).where("_u is not null and _v is not null"))
    small = ends.count() <= ONE_TASK_EDGES

    def settled(df: DataFrame) -> DataFrame:
        # a small graph is contracted in one task, without shuffles; a checkpoint forgets that it is one partition
        return settle(df).coalesce(1) if small else settle(df)

    ends = ends.coalesce(1) if small else ends
    roots = settled(ends.select(F.explode(F.array("_u", "_v")).alias("node")).distinct().withColumn("root", F.col("node")))
    links = settled(ends.where("_u <> _v").select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct())
    while not links.isEmpty():
        # every label hooks onto its smallest neighbour; the forest's paths are halved until all lead to a tree's root
        moved = settled(links.groupBy(F.col("_u").alias("from")).agg(F.min("_v").alias("to")))
        while True:
            step = moved.select(F.col("from").alias("to"), F.col("to").alias("further"))
            joined = settled(moved.join(step, "to", "left"))
            moved = joined.select("from", F.coalesce("further", "to").alias("to"))
            if joined.where("further is not null").isEmpty():
                break
        roots = settled(roots.join(moved.withColumnRenamed("from", "root"), "root", "left")
                       .select("node", F.coalesce("to", "root").alias("root")))
        links = (links.join(moved.select(F.col("from").alias("_u"), F.col("to").alias("_p")), "_u", "left")
                 .join(moved.select(F.col("from").alias("_v"), F.col("to").alias("_q")), "_v", "left")
                 .select(F.coalesce("_p", "_u").alias("_u"), F.coalesce("_q", "_v").alias("_v")).where("_u <> _v"))
        links = settled(links.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct())
    return roots
