"""Connected components of a table of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.joins import spread_join
from lamina.llm.storage import cut, rows_of


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links(a, b); root is the least node of the component.

    Each round hooks every node to its least neighbour, follows the hooks to
    their ends by pointer jumping and contracts the links to those ends. All
    but local minima vanish, so rounds grow with the logarithm of the largest
    component. Only minima are aggregated, so a node with very many links is
    summed map-side, and joins spread it; every step is cut to the shared folder.
    """
    links = cut(links.select("a", "b").where("a <> b"), "links")
    nodes = cut(links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    while rows_of(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "hook")
        while True:
            nxt = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = cut(spread_join(hook, nxt, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "hook")
            hook = jumped.select("a", "p")
            hook.cut_rows = rows_of(jumped)
            if jumped.where("moved").isEmpty():
                break
        to = hook.select(F.col("a").alias("root"), "p")
        nodes = cut(spread_join(nodes, to, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        half = cut(spread_join(links, to.withColumnsRenamed({"root": "a", "p": "pa"}), "a"), "links")
        links = spread_join(half, to.withColumnsRenamed({"root": "b", "p": "pb"}), "b")
        links = links.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        links = cut(links, "links")
    return nodes
