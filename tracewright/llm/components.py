"""Connected components of an edge table, by alternating star contraction.

Each round is two grouped minima and two joins over the edges that are left;
rounds grow with the logarithm of the longest chain.  A hub's neighbours are
never gathered in one group: its minimum is pre-aggregated before the shuffle,
and the join that spreads it can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(a, b)`` with ``a > b``.

    Large: a node's larger neighbours move to its minimum.  Small: a node's
    smaller neighbours, and the node itself, move to its minimum.
    """
    if large:
        flow = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = flow.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = flow.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(low.select("a", F.col("m").alias("b")))
    out = out.where("a <> b")
    return out if large else out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root: the smallest node reachable.

    Self-loops, repeated and null edges are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = stage(now, "edges"), None
    for _ in range(max_rounds):
        then = stage(_star(_star(now, True), False), "edges")
        sign = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = then
        if tuple(sign) == mark:
            break
        mark = tuple(sign)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
