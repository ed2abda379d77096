"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges stay in DataFrames; one round is two grouped joins.  Lineage is cut after each round by a table in the shared
folder.  The rounds end when the set of edges no longer changes, told by its count and an order-free hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: A node with more neighbours than this, and than a thousandth of all edges, has them dealt over SALTS parts.
HOT, SALTS = 1000, 32


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Connects each node's neighbours (large: the larger ones; small: the smaller ones and itself) to its least one.

    The minimum is a partial aggregate joined back, so a hub's neighbours are never gathered in one row.  For that join
    hubs are salted: ``n`` edges have at most 2,000 nodes with more than n / 1000 of them, so the hubs' list is small
    enough to be broadcast, however large the graph.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("m")).select(F.col("u").alias("hub"), F.least("u", "low").alias("low"), "m")
    many = F.col("m") > max(HOT, n // 1000)
    if n > HOT:
        hubs = F.broadcast(least.where(many).select(F.col("hub").alias("h")))
        near = near.join(hubs, F.col("u") == F.col("h"), "left").select("u", "v", F.when(F.col("h").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS))).cast("int").alias("salt"))
        parts = least.select("hub", "low", F.explode(F.sequence(F.lit(0), F.when(many, SALTS - 1).otherwise(0))).alias("part"))
        both = near.join(parts, (F.col("u") == F.col("hub")) & (F.col("salt") == F.col("part")))
    else:
        both = near.join(least, near.u == least.hub)
    if large:
        out = both.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = both.select(F.col("v").alias("a"), F.col("low").alias("b")).union(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b): the component is its smallest node.

    Self-loops and repeated edges do no harm; nulls are left out; without edges the result is empty.
    """
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        new = stored(_star(_star(now, True, mark[0]), False, mark[0]))
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
