"""Fingerprints and incremental runs: what to reuse, parse again, keep or remove."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_digest(engine: str, dialect: str, source_edges: bool, tolerant: bool, schema_parts: list[str]) -> str:
    """Digest of everything but the text that decides a result."""
    return hashlib.sha256("\0".join([engine, dialect, str(source_edges), str(tolerant), *schema_parts]).encode()).hexdigest()


def fingerprints(scripts: DataFrame, context: str) -> DataFrame:
    """``(source_file, fingerprint)`` of ``scripts(source_file, sql)``."""
    return scripts.select("source_file", F.sha2(F.concat(F.lit(context), F.lit("\0"), F.col("sql")).cast("binary"), 256).alias("fingerprint"))


def actions(scripts: DataFrame, stored: DataFrame) -> DataFrame:
    """``(source_file, action)``: reuse, add, replace or remove, from the two fingerprint tables."""
    s = stored.select("source_file", F.col("fingerprint").alias("old"))
    both = scripts.join(s, "source_file", "full")
    act = F.when(F.col("fingerprint").isNull(), "remove").when(F.col("old").isNull(), "add").when(F.col("old") == F.col("fingerprint"), "reuse").otherwise("replace")
    return both.select("source_file", act.alias("action"))
