"""SQL files and test cases as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CASE = "id string, dialect string, kind string, features array<string>, comment string, sql string, schema string, lineage struct<edges:array<struct<`from`:string,`to`:string,kind:string>>,unknowns:array<string>>"


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, sql)`` of all ``*.sql`` files below ``path``, whole, in any letter case."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][qQ][lL]").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("sql"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(cases, problems)`` of the JSON cases below ``path``: of repeated ids the first file counts, bad files are problems."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(CASE + ", _bad string").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("source_file"))
    good = rows.where("_bad IS NULL AND id IS NOT NULL AND sql IS NOT NULL AND dialect IS NOT NULL")
    ranked = good.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("source_file")))
    problems = rows.where("_bad IS NOT NULL OR id IS NULL OR sql IS NULL OR dialect IS NULL").select("source_file", F.lit("unreadable case").alias("problem"))
    again = ranked.where("_n > 1").select("source_file", F.concat(F.lit("duplicate id "), "id").alias("problem"))
    return ranked.where("_n = 1").drop("_n", "_bad").withColumn("kind", F.coalesce("kind", F.lit("SELECT"))), problems.union(again)
