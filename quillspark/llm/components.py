"""Connected components by randomised contraction, for graphs that only fit the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) of every id in edges (a, b).

    In each round a vertex moves to the one of its neighbourhood that comes first: by id, which makes an
    end of stars around their smallest vertex, and in every other round in an order drawn anew, which
    shrinks even long chains by a constant factor. Edges between different targets form the next round's
    graph. Rows a vertex has are combined before they are shuffled. Self-loops and repeated edges are allowed.
    """
    now = durable(edges.filter("a <> b").select("a", "b").distinct())
    moves: list[DataFrame] = []
    while not now.isEmpty():
        drawn = len(moves) % 2 == 1
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct((F.xxhash64(F.lit(len(moves)), F.col(c)) if drawn else F.lit(0)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        to = durable(both.groupBy("a").agg(F.min(order("b")).alias("best")).select("a", F.least(F.col("best"), order("a"))["id"].alias("to")))
        moves.append(to)
        left = now.join(to, "a").select(F.col("to").alias("x"), "b")
        right = left.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        now = durable(right.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not moves:
        return edges.filter("false").select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = moves[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for to in moves[1:]:
        found = found.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    found = durable(found)
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(least, "root").select("id", "component")
