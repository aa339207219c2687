"""Cross-site boilerplate lines (DataFrame functions only).

A line is known by the 64-bit hash of its trimmed text.  Per hash, one grouped
pass keeps the number of rows and the smallest and largest site; only hashes
seen on two sites go on.  For those, HyperLogLog sketches of the sites are
merged by aggregation.  An estimate clear of the threshold by ``BAND`` relative
errors decides; lines nearer to it get an exact distinct count.  Lines on at
least ``MIN_SITES`` sites are removed from every text.

Defined results: a null text has no lines and stays null; blank lines are never
removed; a null site is a site of its own; repeated rows are each cleaned; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, unclaimed

MIN_SITES, LG_K, BAND = 5, 12, 4.0


def _hashes(text: str) -> Column:
    return F.transform(F.split(F.col(text), "\n", -1), lambda x: F.xxhash64(F.trim(x)))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(line)``: hashes of the lines that stand on at least ``min_sites`` sites."""
    blank = F.xxhash64(F.lit(""))
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.xxhash64(F.col(site)), F.lit(0)).alias("site"), F.explode(F.array_distinct(_hashes(text))).alias("line")).where(F.col("line") != blank)
    some = stage(rows.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b")).where((F.col("n") >= min_sites) & (F.col("a") != F.col("b"))).select("line"), "lines")
    wide = stage(rows.join(some, "line"), "wide")
    error = 1.04 / (1 << lg_k) ** 0.5
    sketched = stage(wide.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")), "sketches")
    margin = max(1.0, BAND * error * min_sites)
    sure = sketched.where(F.col("sites") > min_sites + margin).select("line")
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= margin).select("line")
    exact = wide.join(near, "line").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return sure.union(exact)


def clean(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, into: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and their number in ``into``.

    The join key is the text's own hash: what is cut depends on the text alone,
    and each line is still looked up by its hash.  A column of ``docs`` already
    called ``into`` is an error.
    """
    unclaimed(docs, into)
    key = free_name(docs, "_key")
    bad = stage(spread_lines(docs, text, site, min_sites), "spread")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    hits = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias(key), F.explode(F.array_distinct(_hashes(text))).alias("line")).join(bad, "line")
    cut = hits.groupBy(key).agg(F.collect_set("line").alias(key + "cut"))  # at most the lines of one text
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(key + "cut"), F.xxhash64(F.trim(x))))
    out = keyed.join(cut, key, "left").withColumn(key + "kept", F.when(F.col(key + "cut").isNull(), lines).otherwise(kept))
    removed = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(key + "kept"))
    return out.withColumn(into, removed.cast("long")).withColumn(text, F.array_join(key + "kept", "\n")).drop(key, key + "cut", key + "kept")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: lines before, lines removed, and the cleaned text's length and SHA-256."""
    rows = docs.select("doc_id", "source", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    got = clean(rows)
    return got.select("doc_id", "n_lines", "n_removed", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle(min_sites: int = MIN_SITES) -> str:
    """The same result from exact counts, in DuckDB SQL."""
    return f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT u, doc_id, site, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {min_sites}),
k AS (SELECT u, string_agg(l.line, chr(10) ORDER BY p) FILTER (b.line IS NULL) AS t, count(*)::BIGINT AS n_lines, count(b.line)::BIGINT AS n_removed
  FROM l LEFT JOIN b ON b.line = trim(l.line, ' ') GROUP BY u)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  length(coalesce(t, ''))::BIGINT AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (u)"""
