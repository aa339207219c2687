"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate r, the expected number of its copies.  Among all
rates in [0, CAP] whose tokens meet every source's target, the ones closest to
1 in relative entropy are r = min(CAP, exp(lambda_s size / mean_s)): the token
constraint of source s tilts its documents exponentially.  The multipliers
minimise the convex dual, solved for all sources at once by safeguarded Newton
steps, each a grouped sum over the (source, size) histogram of the corpus.

Rates are rounded into whole copies bucket by bucket (a source's documents fall
into hash buckets of about ``BUCKET`` rows, so a hot source spreads over many
tasks): from the longest document down, each takes the whole number of copies
that brings the running total nearest its due, so what is left of the error is
about the size of a bucket's shortest documents.

Defined results: a null text has size 0; null sources form one source, listed
last; size-0 documents are kept once and count nothing; a source of size 0 has
target 0; repeated rows each count, and ties are broken by id and size only, so
reruns agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, discard, stage

CAP, BUCKET, ROUNDS, TOLERANCE = 3.0, 2_000, 60, 1e-9


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` in words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """``(source, source_size, n, target)`` from ``(source, source_size, n)``.

    Shares by weight stop at ``cap`` times the source's size.  Raising a common
    level until the shares fill the total saturates sources in the order of
    size / weight, so running sums over that order give the level directly.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    byname = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    listed = totals.withColumn("total", total).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(byname) - 1) % len(weights) + 1).cast("double"))
    full = listed.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = (F.col("total") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / left
    full = full.withColumn("level", level).withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return full.withColumn("final", final).select("source", "source_size", "n", F.least("most", F.col("weight") * F.coalesce("final", F.lit(0.0))).alias("target"))


def _rate(lam, size, mean, cap):
    return F.least(F.lit(cap), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def solve(histogram: DataFrame, aims: DataFrame, cap: float = CAP) -> DataFrame:
    """``aims`` with the multiplier ``lam`` and ``mean`` size of each source.

    ``histogram(source, size, docs)`` has a row for each size.  The sums are
    decimals, so that their order does not matter and reruns agree.
    """
    spark = histogram.sparkSession
    state = aims.where("source_size > 0").select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), (F.col("source_size") * cap).alias("most"))
    state = stage(state, "duals")
    rows = histogram.where("size > 0").select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "size", "docs")
    for _ in range(ROUNDS):
        r = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        tokens = F.sum((F.col("docs") * F.col("size") * r).cast("decimal(38,6)")).cast("double")
        slope = F.sum((F.when(r < cap, F.col("docs") * F.col("size") * r * F.col("size") / F.col("mean")).otherwise(0.0)).cast("decimal(38,6)")).cast("double")
        step = rows.join(state, ["s", "none"]).groupBy("s", "none").agg(tokens.alias("g"), slope.alias("h"), *[F.first(c).alias(c) for c in ("target", "mean", "lam", "lo", "hi", "most")])
        over = F.col("g") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        miss = F.col("g") - F.col("target")
        done = F.abs(miss) <= F.greatest(F.col("target") * TOLERANCE, F.lit(1e-3))
        full = F.col("target") >= F.col("most") * (1 - 1e-9)
        newton = F.col("lam") - miss / F.greatest("h", F.lit(1e-9))
        newton = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        new = stage(step.select("s", "none", "target", "mean", F.when(full, F.lit(60.0)).when(done, F.col("lam")).otherwise(newton).alias("lam"), lo.alias("lo"), hi.alias("hi"), "most", (~done & ~full & (hi - lo > 1e-12)).alias("open")), "duals")
        discard(spark, state)
        state = new
        if not state.where("open").take(1):
            break
    return state.select(F.when(~F.col("none"), F.col("s")).alias("source"), F.round("lam", 9).alias("lam"), "mean", (F.col("target") >= F.col("most") * (1 - 1e-9)).alias("full"))


def _round(cap: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
        copies, owed = np.ones(len(f), np.int64), 0.0
        for i, (size, rate) in enumerate(zip(f["size"].tolist(), f["rate"].tolist())):
            if size > 0:
                due = rate * size + owed
                low = int(rate)
                copies[i] = min(max(round(due / size), low - 1, 0), low + 2, int(cap))
                owed = due - copies[i] * size
        return f.assign(copies=copies)[["doc_id", "row", "source", "size", "copies"]]

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, row: str | None = None) -> DataFrame:
    """``(doc_id, row, source, size, source_size, target, copies)``: whole copies of each document.

    ``row`` names a column that tells repeated rows apart; it is passed through.
    """
    keep = F.col(row) if row else F.lit(None)
    sized = stage(sizes(docs.select(F.col(doc_id).alias("doc_id"), keep.cast("long").alias("row"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "text").drop("text"), "sizes")
    histogram = stage(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    aims = stage(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n")), weights, cap), "targets")
    duals = solve(histogram, aims, cap)
    facts = aims.join(duals.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")), "left").drop("own").withColumnRenamed("source", "own")
    joined = sized.join(facts, F.col("source").eqNullSafe(F.col("own")))
    rate = F.when(F.col("full"), F.lit(cap)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "size"), F.ceil(F.col("n") / BUCKET))
    dealt = joined.select("doc_id", "row", "source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"), bucket.alias("bucket"))
    rounded = dealt.groupBy("source", "bucket").applyInPandas(_round(cap), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, row long, source string, size long, copies long")
    few = aims.select(F.col("source").alias("own"), "source_size", "target")
    return rounded.join(few, F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "row", "source", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, same columns."""
    from .common import free_name

    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row=row, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(row + "n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(row + "n")))
    return numbered.join(taken, row).withColumn(row + "i", copies).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
