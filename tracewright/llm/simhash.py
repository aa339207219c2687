"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit position i carries a nonzero vector phi(i) of r + 1 bits.  For each of the
2^(r+1) - 1 nonzero vectors v there is a table whose mask keeps the positions
with an odd inner product <phi(i), v>.  At most r differing positions span at
most r dimensions, so some v is orthogonal to all of them: its mask keeps none
of them and the pair collides there.  No pair within the radius is missed.

Buckets are counted first, with partial counts before the shuffle, and only
fingerprints that share one go on.  Buckets above
``LIMIT`` distinct fingerprints are dealt out again by a second covering family over the positions that their mask ignores, so no comparison
group exceeds 2^18 values whatever the data; nothing is capped.  A group yields
a spanning forest of its links, not its pairs.

Defined results: a null or wordless text has fingerprint 0 and links like any
other; repeated rows share their class; a class whose ids are all null has a
null component_id, else nulls are ignored in the minimum; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stage
from .components import components

LIMIT = 2048
_BLOCK = 4096


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's k-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= k:
        return xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = map(slice, starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(whole.__getitem__, cuts), repeat(seed)), np.uint64, n - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them escape one mask."""
    top = (1 << (radius + 1)) - 1
    phi = {p: 1 + j % top for j, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (phi[p] & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs within ``radius`` connect; a value is compared with those not yet reached.

    Edges lead to the first value of each connected set.  Where ``values`` are
    sorted that is its smallest, so no value has many smaller neighbours.
    """
    out, rest = [], values
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(root, int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _linker(radius: int):
    def run(frames):
        for f in frames:
            pairs: list[tuple[int, int]] = []
            for group in f["members"]:
                pairs += forest(np.unique(np.asarray(group, np.int64)).view(np.uint64), radius)
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return run


def links(values: DataFrame, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct 64-bit values ``fp`` within ``radius``."""
    masks = covering(list(range(64)), radius)
    deeper = [[_signed(m | n) for n in covering([p for p in range(64) if not m >> p & 1], radius)] for m in masks]
    deal = lambda ms: F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in ms]))
    dealt = values.select("fp", deal(masks).alias("t", "key"))
    shared = stage(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    sized = dealt.join(shared, ["t", "key"])
    small = sized.where(F.col("n") <= limit).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    again = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in deeper])
    large = sized.where(F.col("n") > limit).select("t", "fp", F.posexplode(F.transform(F.element_at(again, F.col("t") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("t2", "key"))
    large = large.groupBy("t", "t2", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    run = _linker(radius)
    return small.select("members").mapInPandas(run, "a long, b long").union(large.select("members").mapInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document; fp is the fingerprint as a signed long."""
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, k)) for t in texts], dtype="int64")

    own = stage(docs.select(F.col(doc_id).alias("doc_id"), prints(F.col(text)).alias("fp")), "fingerprints")
    values = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(values.select("fp"), radius))
    named = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return own.join(named.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["covering", "digest", "discard", "fingerprint", "forest", "links", "near_duplicates"]
