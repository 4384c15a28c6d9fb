"""Connected components by contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of 64-bit hashes -> one row (node, root) for each node on
    an edge between two nodes; the nodes of a component share the root.

    Each round sends a node to its smallest neighbour and contracts, so the
    number of edges falls geometrically (node numbers are hashes, so long
    ascending paths do not occur). Minima are aggregated before the shuffle, and
    each round's tables are checkpointed, so a lost executor repeats one round.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        if found is None:
            found = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            found = cut(found.join(to, found.root == to.a, "left")
                        .select("node", F.coalesce("to", "root").alias("root")))
        if links.isEmpty():
            return found
        far = to.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        links = cut(links.join(to, "a").join(far, "b").where("to <> to_b")
                    .select(F.greatest("to", "to_b").alias("a"), F.least("to", "to_b").alias("b")).distinct())
        if links.isEmpty():
            return found
