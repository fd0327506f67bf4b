"""Graphs as edge tables: neighbours, patterns, suggestions, shortest paths, cycles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, node, kind: str | None = None, direction: str = "out") -> DataFrame:
    if direction not in ("out", "in"):
        raise ValueError("direction is out or in")
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.where(F.col(own) == node)
    return (e if kind is None else e.where(F.col("type") == kind)).select(F.col(other).alias("id")).distinct().orderBy("id")


def check_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()


def match(nodes: DataFrame, edges: DataFrame, src_label: str, kind: str, dst_label: str, where: Column | None = None) -> DataFrame:
    """(a, b) of the pattern (a:src_label)-[kind]->(b:dst_label); `where` may use the columns of both ends as a.* and b.*."""
    a = nodes.where(F.col("label") == src_label).alias("a")
    b = nodes.where(F.col("label") == dst_label).alias("b")
    e = edges.where(F.col("type") == kind).alias("e")
    m = e.join(a, F.col("e.src") == F.col("a.id")).join(b, F.col("e.dst") == F.col("b.id"))
    return (m if where is None else m.where(where)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def suggestions(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, suggested): friends of friends who are neither direct friends nor the person. One join of edges with edges by the middle."""
    e = (edges if kind is None else edges.where(F.col("type") == kind)).select("src", "dst").distinct()
    two = e.select(F.col("src").alias("id"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("suggested")), "mid").where("id <> suggested").select("id", "suggested").distinct()
    return two.join(e.select(F.col("src").alias("id"), F.col("dst").alias("suggested")), ["id", "suggested"], "left_anti")


def shortest_path(edges: DataFrame, src, dst, kind: str | None = None) -> list | None:
    """The nodes of a path with the fewest hops, of several the first in node order; None where there is none.

    The frontier grows by one join a hop and stops when it reaches the end or nothing is new. Parents are kept as a table in
    the checkpoint folder, and only the path itself comes to the driver.
    """
    from ..sources.scratch import Scratch

    if src == dst:
        return [src]
    e = (edges if kind is None else edges.where(F.col("type") == kind)).select("src", "dst").distinct()
    tmp = Scratch(edges.sparkSession, "path")
    seen = tmp.save(edges.sparkSession.createDataFrame([(src, None, 0)], f"id {dict(edges.dtypes)['src']}, parent {dict(edges.dtypes)['src']}, hop int"), "0")
    for hop in count(1):
        step = seen.where(F.col("hop") == hop - 1).join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        new = step.select(F.col("dst").alias("id"), "parent", F.lit(hop).alias("hop")).join(seen.select("id"), "id", "left_anti")
        grown = tmp.save(seen.unionByName(new.select(*seen.columns)), str(hop))
        if grown.where(F.col("hop") == hop).isEmpty():
            return None
        seen = grown
        if not seen.where((F.col("id") == dst) & (F.col("hop") == hop)).isEmpty():
            path = [dst]
            for h in range(hop, 0, -1):
                path.append(seen.where((F.col("id") == path[-1]) & (F.col("hop") == h)).first()["parent"])
            return path[::-1]


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle or on a path between cycles: what is left after nodes without a way in or out are removed, again and again.

    A wait-for graph has a deadlock exactly when something is left. Rounds grow with the longest chain that hangs off.
    """
    from ..sources.scratch import Scratch

    tmp = Scratch(edges.sparkSession, "cycle")
    e = tmp.save(edges.select("src", "dst").distinct(), "0")
    n = e.count()
    for i in count(1):
        heads, tails = e.select(F.col("src").alias("dst")).distinct(), e.select(F.col("dst").alias("src")).distinct()
        e = tmp.save(e.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst"), str(i))
        m = e.count()
        if m == n:
            break
        n = m
    return e.select(F.col("src").alias("id")).distinct()


def reachable(spark, view: str = "edges") -> DataFrame:
    """(src, dst) of all pairs that a path connects, by a recursive query over a view with src and dst; for small graphs."""
    return spark.sql(f"WITH RECURSIVE r(src, dst, seen) AS (SELECT src, dst, array(src, dst) FROM {view} UNION ALL SELECT r.src, e.dst, array_append(r.seen, e.dst) FROM r JOIN {view} e ON e.src = r.dst WHERE NOT array_contains(slice(r.seen, 2, 1000), e.dst)) SELECT DISTINCT src, dst FROM r")
