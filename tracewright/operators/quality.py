"""Quality of extracted lineage against hand-made expectations, and coverage matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default conversion pairs.
PAIRS = tuple("ansi>calcite calcite>ansi ansi>mysql ansi>postgresql mysql>postgresql postgresql>mysql ansi>trino trino>ansi mysql>hive hive>mysql mysql>spark spark>mysql mysql>bigquery bigquery>mysql mysql>oracle oracle>mysql mysql>tsql tsql>mysql postgresql>oracle oracle>postgresql".split())


def pairs(text: str) -> list[tuple[str, str]]:
    """``from>to`` pairs, comma separated; empty, equal or malformed sides are an error."""
    out = []
    for x in text.lower().split(","):
        a, sep, b = (y.strip() for y in x.partition(">"))
        if not (a and sep and b) or a == b:
            raise ValueError(f"invalid pair: {x!r}")
        out.append((a, b))
    return out


def compare(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """``(case_id, from_id, to_id, kind, verdict)``: tp, fp or fn for each distinct edge.

    Emitted edges count only in the kinds that the case asserts; a case with no
    expected edge (``from_id`` null) asserts every kind.
    """
    key = ["case_id", "from_id", "to_id", "kind"]
    folded = lambda df: df.select("case_id", F.lower("from_id").alias("from_id"), F.lower("to_id").alias("to_id"), "kind")
    want = folded(expected.where("from_id IS NOT NULL")).distinct().withColumn("w", F.lit(True))
    asserted = want.select("case_id", "kind").distinct()
    cases = expected.select("case_id").distinct()
    got = folded(emitted).distinct().join(cases, "case_id", "left_semi")
    free = cases.join(asserted.select("case_id").distinct(), "case_id", "left_anti")
    got = got.join(asserted, ["case_id", "kind"], "left_semi").unionByName(got.join(free, "case_id", "left_semi")).withColumn("g", F.lit(True))
    both = want.join(got, key, "full")
    return both.select(*key, F.when(F.col("w") & F.col("g"), "tp").when(F.col("w"), "fn").otherwise("fp").alias("verdict"))


def ratios(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts and precision and recall; a ratio without a denominator is null."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    out = verdicts.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    share = lambda d: F.when(d > 0, F.col("tp") / d)
    return out.withColumn("precision", share(F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp") + F.col("fn")))


def gaps(verdicts: DataFrame, declared: DataFrame) -> DataFrame:
    """Missed edges whose source is not among the case's declared unknowns ``(case_id, from_id)``."""
    return verdicts.where("verdict = 'fn'").join(declared, ["case_id", "from_id"], "left_anti")


def unknown_rate(statements: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Unknowns over column references of all statements."""
    u = unknowns.agg(F.count("*").alias("unknowns"))
    r = statements.agg(F.coalesce(F.sum("n_references"), F.lit(0)).alias("references"))
    return u.join(F.broadcast(r)).withColumn("rate", F.when(F.col("references") > 0, F.col("unknowns") / F.col("references")))  # both sides are one row


def coverage(cells: DataFrame, by: str = "dialect") -> DataFrame:
    """``cells(case_id, dialect, engine, ok)`` to ok and total for each dialect and engine."""
    return cells.groupBy(by, "engine").agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.count("*").alias("total"))


def pivot_totals(cells: DataFrame, engines: list[str]) -> DataFrame:
    """One row for each dialect, columns ``<engine>_ok`` and ``<engine>_total`` for each engine; 0 where there is no cell."""
    out = coverage(cells).groupBy("dialect").pivot("engine", engines).agg(F.sum("ok").alias("ok"), F.sum("total").alias("total"))
    return out.select("dialect", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "dialect"))


def pivot(cells: DataFrame, engines: list[str]) -> DataFrame:
    """One row for each dialect, one column of ok counts for each engine."""
    return cells.groupBy("dialect").pivot("engine", engines).agg(F.sum(F.col("ok").cast("long")))
