"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins of (node, smallest neighbour) with the edges; the driver sees only
a count and a checksum. Each round's edges are written to the shared folder, so lineage does
not grow and a lost executor repeats one round at most. The minima are written too before they
are joined: both sides of a join then come from an exchange, and the edges of a hub, however many,
are split over tasks (or the minima are broadcast, where their written size allows it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.shared import drop, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new edges, the written minima that they read)"""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    # every edge now points from its larger to its smaller end
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "minima")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), least


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that each node of `edges` (a, b) reaches.

    Nodes are longs. Self-loops, repeated and reversed edges are fine; null ends are dropped;
    no edges give no rows. Nodes without an edge don't appear.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(clean, "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        star, least = _large_star(now)
        large = materialize(star, "edges")
        drop(now)
        drop(least)
        star, least = _small_star(large)
        small = materialize(star, "edges")
        drop(large)
        drop(least)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
