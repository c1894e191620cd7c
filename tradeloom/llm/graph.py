"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component) for every id in an edge; component is the smallest id reachable.

    Each round maps every id to the smallest of itself and its neighbours and
    renames the edges; edges within one id go. The number of ids at least halves
    in each round, as every id that is left is mapped or is mapped to. The maps
    are then applied in turn. All steps are joins and aggregates of written
    tables; the smallest id of a component is never renamed, so it is the name.
    """
    maps = []
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        maps.append(to)
        a, b = (to.select(F.col("a").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b"))
        new = left.join(a, "a").join(b, "b").where("a_to <> b_to")
        left = materialize(new.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for m in maps[1:]:
        nxt = m.select(F.col("a").alias("component"), "to")
        out = out.join(nxt, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return materialize(out)
