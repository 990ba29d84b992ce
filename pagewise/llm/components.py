"""Connected components by rounds of grouped minima, nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the least node that each node of ``edges`` reaches.

    A round gives every node the least root among its own and its neighbours',
    passes what the members of a tree found on to the tree's root, and then
    follows roots one step further, so chains shorten by half or better a round.
    All steps are minima with map-side combination and joins on unique sides.
    What a tree's root found is looked up by its members over salted keys, so a
    tree of most nodes is no task's alone; edges of a hub meet its root in a
    plain join of two cut-off sides, whose large keys Spark can split. No edges:
    no rows. Edges with a null end are left out; repeated ones count once.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = cut(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    roots = cut(both.groupBy("x").agg(F.min("y").alias("root")).select("x", F.least("x", "root").alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = cut(roots.join(near, "x").select("x", "root", F.least("root", "near").alias("found")))
        hook = step.groupBy("root").agg(F.min("found").alias("up")).where("up < root")
        moved = cut(salted(step, hook, "root", "x", "left").select("x", F.least("found", "up").alias("root"), F.col("root").alias("was")))
        up = moved.select(F.col("x").alias("root"), F.col("root").alias("above")).where("above < root")
        after = cut(salted(moved, up, "root", "x", "left").select("x", F.coalesce("above", "root").alias("root"), "was"))
        if after.where("root <> was").isEmpty():
            return after.select(F.col("x").alias("node"), "root")
        roots = after.select("x", "root")
