"""Lineage store: the fact table as Parquet in hash buckets of its sources, replaced bucket by bucket."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

VERSION, BUCKETS = "2", 256
_SCHEMA = "statement_index int, what string, ordinal int, body string, fingerprint string, source_file string, bucket int"
_COLUMNS = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


class StoreError(ValueError):
    """A store that cannot be opened or written as asked."""


class LineageStore:
    """``path/facts`` holds ``BUCKETS`` partitions at most, by the hash of the source's name; ``path/info`` the version.

    A store of version 1, which has no fingerprints, is brought to this version when it is opened.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        info = self._info()
        if info is None:
            self._sign()
        elif info == "1":
            self._migrate()
        elif info != VERSION:
            raise StoreError(f"store version {info} is not supported")

    def _sign(self) -> None:
        self.spark.createDataFrame([("version", VERSION)], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{self.path}/info")

    def _migrate(self) -> None:
        fs, path = self._fs("facts")
        if fs.exists(path):
            old = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/facts")
            self._put(cut(self._keyed(old.withColumn("fingerprint", F.lit(None).cast("string")), None)), "static")
        self._sign()

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _info(self) -> str | None:
        fs, path = self._fs("info")
        if not fs.exists(path):
            return None
        return {r["key"]: r["value"] for r in self.spark.read.schema("key string, value string").json(f"{self.path}/info").collect()}.get("version")

    def load(self) -> DataFrame:
        """All facts."""
        fs, path = self._fs("facts")
        if not fs.exists(path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/facts")

    def _keyed(self, facts: DataFrame, prints: DataFrame | None) -> DataFrame:
        if prints is not None:
            own = prints.select(F.col("source_file").alias("f"), "fingerprint").distinct()
            if own.groupBy("f").count().where("count > 1").take(1):
                raise StoreError("a source has several fingerprints")
            facts = facts.drop("fingerprint").join(own, F.col("source_file").eqNullSafe(F.col("f")))
        return facts.withColumn("bucket", F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int")).select(*_COLUMNS)

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/facts")

    def _rewrite(self, gone: DataFrame, new: DataFrame | None) -> None:
        """Write the buckets of ``gone(source_file)`` again without those sources and with ``new``."""
        marked = gone.select(F.col("source_file").alias("f"), F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
        touched = [r[0] for r in marked.select("b").distinct().collect()]  # BUCKETS rows at most
        old = self.load().where(F.col("bucket").isin(touched)).join(marked, F.col("source_file").eqNullSafe(F.col("f")) & (F.col("bucket") == F.col("b")), "left_anti")
        rows = cut(old if new is None else old.unionByName(new))
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        self._put(rows, "dynamic")
        for b in touched:
            if b not in left:
                fs, path = self._fs(f"facts/bucket={b}")
                fs.delete(path, True)

    def save(self, facts: DataFrame, prints: DataFrame) -> None:
        """Replace everything; each source has one fingerprint."""
        self._put(cut(self._keyed(facts, prints)), "static")

    def replace(self, facts: DataFrame, prints: DataFrame) -> None:
        """Replace the sources that ``facts`` has; only their buckets are written, and each source has one fingerprint."""
        rows = cut(self._keyed(facts, prints))
        if not rows.take(1):
            raise StoreError("nothing to replace")
        self._rewrite(rows.select("source_file"), rows)

    def remove(self, sources: list[str] | DataFrame) -> int:
        """Delete the facts of ``sources`` (names, or a table with ``source_file``); how many there were."""
        gone = sources if isinstance(sources, DataFrame) else self.spark.createDataFrame([(s,) for s in sources], "source_file string")
        known = cut(self.fingerprints().join(gone.select(F.col("source_file").alias("f")).distinct(), F.col("source_file").eqNullSafe(F.col("f")), "left_semi").select("source_file"))
        n = known.count()
        if n:
            self._rewrite(known, None)
        return n

    def clear(self) -> None:
        fs, path = self._fs("facts")
        fs.delete(path, True)

    def fingerprints(self) -> DataFrame:
        return self.load().groupBy("source_file").agg(F.first("fingerprint", ignorenulls=True).alias("fingerprint"))

    def count(self) -> int:
        return self.load().where("what = 'statement'").count()

    def summary(self) -> str:
        return json.dumps({r["what"]: r["count"] for r in self.load().groupBy("what").count().orderBy("what").collect()})


def library(spark: SparkSession, root: str) -> DataFrame:
    """``(name, models)`` of the stores right below ``root``, by name; their files are read in one job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []
    has = lambda n, part: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/{part}"))
    stores = spark.createDataFrame([(n,) for n in names if has(n, "info")], "name string")
    full = [f"{root}/{n}/facts" for n in names if has(n, "info") and has(n, "facts")]
    if not full:
        return stores.withColumn("models", F.lit(0).cast("long"))
    facts = spark.read.schema("what string").option("recursiveFileLookup", True).parquet(*full).where("what = 'statement'")
    counts = facts.groupBy(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]*)/facts/[^/]*/[^/]*$", 1)).alias("name")).count()
    return stores.join(counts, "name", "left").select("name", F.coalesce("count", F.lit(0)).alias("models")).orderBy("name")


def locate(root: str, name: str) -> str:
    """The path of a store in ``root``; a name that could leave ``root`` is an error."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise StoreError(f"invalid_graph_ref: {name}")
    return f"{root}/{name}"
