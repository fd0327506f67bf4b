"""Connected components of an edge table, by joins: small stars with pointer jumping, a table in the shared folder each round."""

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BROADCAST_ROWS = 200_000  #: of two longs

def connected_components(edges: DataFrame, tmp: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component; edges are (a, b) longs.

    Each edge points from its larger to its smaller end. A round moves each node's edges to its smallest neighbour m, and
    replaces a neighbour by that neighbour's own smallest. It ends when all edges point to roots and each node has one.
    A node groups only its smaller neighbours, so the hub of a large star, being its smallest node, is never a group.
    """
    e = tmp.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for k in count(1):
        low = tmp.save(e.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low-{k}")
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        jump = low.select(F.col("u").alias("v"), F.col("m").alias("to"))
        jump = F.broadcast(jump) if low.count() <= BROADCAST_ROWS else jump  # most edges of a large group share one v
        n = tmp.save(moved.join(jump, "v", "left").select("u", F.coalesce("to", "v").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{k}")
        tmp.drop(f"{name}-{k - 1}")
        tmp.drop(f"{name}-low-{k}")
        e = n
        nodes = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if nodes["n"] == nodes["d"] and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
