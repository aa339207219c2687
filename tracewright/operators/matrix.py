"""Matrices over test cases ``(id, dialect, features, sql)``: what parses, what converts, quality by feature."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import analyse
from ..functions import rewrite
from .quality import PAIRS, pairs, ratios

ENGINE = "tokens"
#: The feature names of an engine; those absent carry their reason.
FEATURES = "PARSE EXTRACT_TABLES DIALECT_PARSE DIALECT_RENDER VALIDATE_SCHEMA FIELD_LINEAGE SEMANTIC_MODEL PRETTY_PRINT ERROR_TOLERANT AST_EXPORT MULTI_STATEMENT".split()
ABSENT = {"DIALECT_PARSE": "the union of the dialects is read, whatever the dialect's name"}


def capabilities(spark: SparkSession) -> DataFrame:
    """``(engine, feature, supported, reason)``, a row for each feature name."""
    return spark.createDataFrame([(ENGINE, f, f not in ABSENT, ABSENT.get(f)) for f in FEATURES], "engine string, feature string, supported boolean, reason string")


def shorten(text: str, most: int) -> str:
    """``text``, or its first ``most`` characters and an ellipsis."""
    return text if len(text) <= most else text[:most] + "…"


def compatibility(cases: DataFrame) -> DataFrame:
    """``(case_id, dialect, engine, ok, statements, unknowns, reason)`` of each case, read without a schema.

    A case is ok if no statement of it has an error; the reason is the first error's.
    A null text counts as empty, which is an error.
    """

    def run(frames):
        for f in frames:
            out = []
            for case, dialect, sql in zip(f["id"], f["dialect"], f["sql"]):
                facts = analyse(sql or "")
                errors = [b["message"] for _, w, _, b in facts if w == "diagnostic" and b["severity"] == "ERROR"]
                count = lambda what: sum(w == what for _, w, _, _ in facts)  # noqa: B023, E731
                out.append((case, dialect, ENGINE, not errors, count("statement"), count("unknown"), shorten(errors[0], 40) if errors else None))
            yield pd.DataFrame(out, columns=["case_id", "dialect", "engine", "ok", "statements", "unknowns", "reason"])

    return cases.select("id", "dialect", "sql").mapInPandas(run, "case_id string, dialect string, engine string, ok boolean, statements long, unknowns long, reason string")


def conversions(cases: DataFrame, wanted: str = ",".join(PAIRS)) -> DataFrame:
    """``(case_id, pair, engine, ok, sql, reason)`` of each case and each ``from>to`` pair that starts at its dialect."""
    todo = pairs(wanted)

    def run(frames):
        for f in frames:
            out = []
            for case, dialect, sql in zip(f["id"], f["dialect"], f["sql"]):
                for a, b in todo:
                    if dialect is not None and a == dialect.lower():
                        text, why = rewrite.convert(sql or "", a, b)
                        out.append((case, f"{a}>{b}", ENGINE, text is not None, text, shorten(why, 120) if why else None))
            yield pd.DataFrame(out, columns=["case_id", "pair", "engine", "ok", "sql", "reason"])

    return cases.select("id", "dialect", "sql").mapInPandas(run, "case_id string, pair string, engine string, ok boolean, sql string, reason string")


def by_feature(verdicts: DataFrame, cases: DataFrame) -> DataFrame:
    """Precision and recall of each feature tag; a case counts for each of its distinct tags."""
    tags = cases.select(F.col("id").alias("case_id"), F.explode(F.array_distinct("features")).alias("feature"))
    return ratios(verdicts.join(tags, "case_id"), "feature")


def details(cells: DataFrame, annotated: DataFrame) -> DataFrame:
    """Cells of the cases in ``annotated(case_id)`` and of those that failed."""
    known = annotated.select("case_id").distinct().withColumn("_a", F.lit(True))
    return cells.join(known, "case_id", "left").where("_a OR NOT ok").drop("_a")
