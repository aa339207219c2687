"""Cutting the lineage of iterative plans with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a stored table, in folders by the column ``by`` if one is given: later rounds read files, not an ever longer plan."""
    path = f"{folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/round-{uuid.uuid4().hex}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, "true")  # the shuffle files of a stored table are of no more use
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        df.sparkSession.conf.set(name, old)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
