"""Incremental runs over a store: one batch, or a stream of a folder of SQL files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import LineageEngine
from ..functions.checkpoints import cut
from ..operators.incremental import actions, fingerprints
from ..sources.store import LineageStore


def update(store: LineageStore, scripts: DataFrame, context: str, catalog: DataFrame | None = None, removed: bool = True, **options) -> DataFrame:
    """Bring the store up to date; ``(source_file, action)``.

    Unchanged sources are reused.  Changed ones are parsed again and replaced;
    one that no longer parses keeps its old lineage (``failed``).  With
    ``removed``, sources that are gone leave the store.
    """
    prints = fingerprints(scripts, context)
    plan = cut(actions(prints, store.fingerprints()))
    todo = scripts.join(plan.where("action IN ('add', 'replace')"), "source_file", "left_semi")
    facts = cut(LineageEngine(scripts.sparkSession).facts(todo, catalog, **options))
    bad = facts.where("what = 'diagnostic'").where(F.get_json_object("body", "$.severity") == "ERROR").select("source_file").distinct()
    good = cut(facts.join(facts.where("what = 'statement'").select("source_file").distinct(), "source_file", "left_semi").join(bad, "source_file", "left_anti"))
    if good.take(1):
        store.replace(good, prints)
    if removed:
        store.remove(plan.where("action = 'remove'").select("source_file"))
    return plan.join(bad.withColumn("bad", F.lit(True)), "source_file", "left").select("source_file", F.when(F.col("bad"), "failed").otherwise(F.col("action")).alias("action"))


def watch(store: LineageStore, path: str, context: str, checkpoint: str, **options):
    """A running stream: new and changed ``*.sql`` files below ``path`` update the store in micro-batches."""
    spark = store.spark
    files = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][qQ][lL]").format("text").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("sql"))

    def each(batch: DataFrame, _: int) -> None:
        update(store, cut(batch.dropDuplicates(["source_file"])), context, removed=False, **options)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
