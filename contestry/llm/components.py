"""Connected components of an edge table by randomised contraction.

Every round replaces each vertex by the neighbour (or itself) of smallest random rank and drops loops and
repeated edges, which shrinks any graph, chains included, by a constant factor on average. Only minima are
gathered per vertex, never neighbour lists, so a hub costs one partial aggregate. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (id, component): the smallest id reachable, for every id that has an edge.

    Nulls and loops are ignored, repeated and reversed edges count once; no edges give an empty table.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = cut(edges.where("a <> b").distinct())
    layers: list[DataFrame] = []
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("b", "a"))

        def rank(c, salt=turn):
            return F.struct(F.xxhash64(F.lit(salt), c).alias("r"), F.col(c).alias("v"))

        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        layer = cut(best.select(F.col("a").alias("id"), F.least(rank("a"), "m")["v"].alias("to")))
        layers.append(layer)
        left = edges.join(layer.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
        moved = left.join(layer.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b").select(
            F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b")
        edges = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not layers:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = layers[0].select("id", F.col("to").alias("at"))
    for layer in layers[1:]:
        step = layer.select(F.col("id").alias("at"), F.col("to"))
        roots = roots.join(step, "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    roots = cut(roots)
    least = roots.groupBy("at").agg(F.min("id").alias("component"))
    return roots.join(least, "at").select("id", "component")
