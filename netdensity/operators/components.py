"""Connected components of a link table, by alternating star contraction.

Each round points every node's larger neighbours at its least neighbour (large star), then
joins the smaller neighbours of each node to the least of them (small star). Both are a grouping and a
join on the node, so no group is held in one task, and rounds grow with the logarithm of the
longest chain. Links never reach the driver: it sees one count a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(node, root) for every node with a link to another, root being the least node that it reaches.

    Self links and null ends are dropped; a node without links has no row. ``dealt`` is applied to each round's links before they are kept.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v").distinct()
    )
    edges = materialize(dealt(edges))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Large star: the neighbours above a node go to its least neighbour.
        large = both.join(least, both.u == least.k).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lower neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, large.u == low.k)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        after = materialize(dealt(small))
        # Stable when every node has one link and no root has one.
        same = after.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0 and edges.join(after, ["u", "v"], "left_anti").limit(1).count() == 0
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
