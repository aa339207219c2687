"""From raw documents to token files in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``.

Defined results, stage by stage: language ID rejects null texts and texts without
a letter; of the rest of wordless texts SimHash keeps one, and of rows that
repeat, one; no text is too long for a stage; a row without a doc_id or source is
a row like others; ties go to the smaller doc_id; empty tables pass through as
empty tables; further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, langid, mixing, simhash, tokenstore
from tracewright.llm.common import discard, free_name, scratch, stage, table
from tracewright.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject; it learns from all labelled ones."""
    into = free_name(docs, "_language")
    found = langid.predict(docs, langid.fit(docs), into=into)
    return found.where(~F.col(f"{into}.rejected")).drop(into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each SimHash group; of rows that repeat its id, one."""
    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ids = simhash.near_duplicates(numbered.withColumn(row + "id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))), doc_id=row + "id")
    firsts = ids.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return numbered.join(firsts, row, "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeated(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: a row for each document written."""
    return tokenstore.digest(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token files", write_tokens),
]

#: SQL cannot express these stages; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage_of) in enumerate(STAGES):
        with scratch(spark) as kept:
            then = stage(stage_of(spark, docs, sf_dir), name.split()[0].lower())
            kept.append(then)
        if i:
            discard(spark, docs)
        docs = then
    return docs
