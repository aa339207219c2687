"""Joins on a key and a range of whole numbers.

Spark joins such pairs on the key alone and tries every pair of a key.  Here
ranges and values meet in bins, so that only near pairs are tried, and a bin
with many rows on both sides is dealt to a grid of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

#: Rows of either side that meet in one block.
SIDE = 2048
#: Pairs of blocks' rows that a task should try.
PAIRS = 16_000_000


def within(a: DataFrame, b: DataFrame, key: str, width: int = 1) -> DataFrame:
    """``(x, y)`` for rows of ``a(key, lo, hi, x)`` and ``b(key, v, y)`` with equal keys and ``lo < v <= hi``.

    ``lo``, ``hi`` and ``v`` are whole numbers, bins hold ``width`` of them; nulls
    meet nothing.  A bin's rows are dealt to blocks by their hash, and each block
    of ``a`` meets each of ``b``: rows are repeated once for ``SIDE`` on the other side.
    """
    at = lambda c: F.floor(c / F.lit(width)) if width > 1 else c
    lo, hi, v = (F.col(c).cast("long") for c in ("lo", "hi", "v"))
    x = a.where("lo < hi").select(key, "lo", "hi", "x", F.explode(F.sequence(at(lo + 1), at(hi))).alias("bin"))
    y = b.where("v IS NOT NULL").select(key, "v", "y", at(v).alias("bin"))
    size = lambda df, n: df.groupBy(key, "bin").agg(F.count("*").alias(n))
    cells = cut(size(x, "m").join(size(y, "n"), [key, "bin"]))
    pairs = cells.agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS) + 1)
    blocks = cells.select(key, "bin", F.ceil(F.col("m") / SIDE).alias("m"), F.ceil(F.col("n") / SIDE).alias("n"))
    to = [key, "bin", "i", "j"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = x.join(blocks, [key, "bin"]).select("lo", "hi", "x", key, "bin", F.pmod(F.xxhash64("x", "lo", "hi"), "m").alias("i"), every("n").alias("j")).repartition(parts, *to)
    y = y.join(blocks, [key, "bin"]).select("v", "y", key, "bin", every("m").alias("i"), F.pmod(F.xxhash64("y", "v"), "n").alias("j")).repartition(parts, *to)
    return x.join(y, to).where("lo < v AND v <= hi").select("x", "y")
