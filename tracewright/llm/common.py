"""Shared plumbing: the cluster's shared folder, staged tables, file access.

Everything an operator keeps between two steps goes through :func:`stage`,
which writes Parquet below ``spark.checkpoint.dir``.  Those files survive the
loss of any executor, and they cut the lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here defines it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Where that is unset, a local master gets a
    temporary folder of its own and any other master is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder URI below the shared root."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting that holds within the block and is put back after it."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Staged tables made within the block are deleted after it, but for those that the yielded list is given."""
    kept: list[DataFrame] = []
    _made.append([])
    try:
        yield kept
    finally:
        used = {f.rsplit("/", 1)[0] for df in kept for f in df.inputFiles()}
        discard(spark, *[p for p in _made.pop() if not any(u.endswith(p.split(":", 1)[-1].lstrip("/")) for u in used)])


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared root and read it back; the write's shuffle files are dropped once it is over."""
    spark = df.sparkSession
    path = workspace(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    for made in _made:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete staged tables (or folders) that no later step reads."""
    sc = spark.sparkContext
    for x in frames:
        for name in [x] if isinstance(x, str) else {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """``(filesystem, path)`` for a URI; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that batches of long texts stay small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_fold(col: str, modulus: int) -> Column:
    """``crc32(col as text) mod modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def unclaimed(df: DataFrame, into: str) -> None:
    """An error if ``df`` has a column ``into``, which an operator would overwrite."""
    if into.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {into} already; choose another name by into=")
