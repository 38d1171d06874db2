"""Connected components of a link table, without any node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.tables import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id reachable. Ids are of any type with an order.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each an
    aggregation for the smallest neighbour and a join back on the node, until
    every node has one link, and that to a node with none: about log(n) rounds. Joins on a hub's many links can be
    split by adaptive execution. No links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if not edges.head(1):
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        # large star: each node's larger neighbours point at its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point at the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        again = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(again.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(edges)
        edges = now
        # one row a node that has a larger neighbour: how many smaller ones it has, and whether it has a larger one
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR (up > 0 AND root > 0)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
