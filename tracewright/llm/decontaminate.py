"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words without ASCII punctuation.  A seed is a fixed mask
over consecutive tokens that hashes the positions marked 1 and ignores the rest.
The masks of ``MASKS`` catch every window of ``WINDOW`` tokens with at most two
substitutions.  Seeds of training texts that pass a Bloom filter of the
benchmark's seeds are joined with those seeds; each hit lays the item along the
text, and the text is contaminated if some window of ``WINDOW`` aligned tokens
(the whole item, where that is shorter) agrees in at least ``SIMILARITY``.

An item shorter than ``WINDOW`` has masks of its own length instead: its tokens
are cut into groups, and each mask leaves out as many groups as the item may have
substitutions, so every pattern that the check accepts leaves some mask whole.

Defined results: null and wordless texts and items match nothing; equal
texts are one item, named by their smallest item_id; texts are told apart by
themselves, not by item_id, so texts that share an item_id are all compared, and
each counts in ``n_items`` though the list names their item_id once; an item whose
item_id is null counts in ``n_items`` and has no entry in the list; repeated documents are each reported; an empty benchmark contaminates nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, stage

#: Fixed masks: with them any 13 tokens with two substitutions share a seed.
MASKS = ("11010011", "11111")
WINDOW, SIMILARITY, BLOOM_BITS = 13, 0.8, 1 << 26
_FOLD = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's tokens."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _seed(t: np.ndarray, offsets: list[int], span: int, salt: int) -> np.ndarray:
    n = len(t) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt + 1, np.uint64)
    for o in offsets:
        h = (h ^ t[o : o + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


@cache
def short_masks(n: int) -> tuple[str, ...]:
    """Masks over all tokens of an item of ``n``: of the fewest groups that leave each mask 5 tokens, or else of single tokens."""
    wrong = n - math.ceil(SIMILARITY * n - 1e-9)
    for groups in range(wrong + 1, n + 1):
        of = [i * groups // n for i in range(n)]
        out = tuple("".join("0" if g in off else "1" for g in of) for off in combinations(range(groups), wrong))
        if min(m.count("1") for m in out) >= 5:
            break
    return out


def seeds(t: np.ndarray, masks: tuple[str, ...], salt: int = 0):
    """``(hashes, positions)`` of each mask over the tokens."""
    for m, mask in enumerate(masks, salt):
        h = _seed(t, [i for i, c in enumerate(mask) if c == "1"], len(mask), m)
        yield h, np.arange(len(h))


def _families(short) -> list[tuple[tuple[str, ...], int]]:
    """Masks and salts for the windows and for the item lengths in ``short``."""
    return [(MASKS, 0)] + [(short_masks(n), 1000 * n) for n in short]


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(bits - 1), (h >> np.uint64(33)) & np.uint64(bits - 1)


def _item_seeds(frames):
    for f in frames:
        out = []
        for item, text in zip(f["item_key"], f["text"]):
            t = tokens(text)
            if len(t):
                family = _families([len(t)] if len(t) < WINDOW else [])[-1]
                h, p = map(np.concatenate, zip(*seeds(t, *family)))
                out.append(pd.DataFrame({"seed": h.view(np.int64), "at": p, "item_key": item, "item": [t.tobytes()] * len(h)}))
        if out:
            yield pd.concat(out)


def _filler(bits: int):
    def run(frames):
        bloom, lengths = np.zeros(bits, bool), 0
        for f in frames:
            h = f["seed"].to_numpy().view(np.uint64)
            for b in _bits(h, bits):
                bloom[b] = True
            for n in f["length"][f["length"] < WINDOW].unique():
                lengths |= 1 << int(n)
        yield pd.DataFrame({"bloom": [np.packbits(bloom).tobytes()], "lengths": [lengths]})

    return run


def _finder(shared):
    def run(frames):
        packed, bits, short = shared.value
        families = _families(short)
        bloom = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for f in frames:
            out = []
            for key, text in zip(f["key"], f["text"]):
                t = tokens(text)
                found = []
                for family in families:
                    for h, p in seeds(t, *family):
                        a, b = _bits(h, bits)
                        some = np.flatnonzero(bloom[a] & bloom[b])
                        found.append((h[some], p[some]))
                h, p = map(np.concatenate, zip(*found))
                if len(h):
                    out.append((key, t.tobytes(), h.view(np.int64).tolist(), p.tolist()))
            yield pd.DataFrame(out, columns=["key", "tokens", "seed", "at"])

    return run


def agreement(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, least: float = SIMILARITY) -> int:
    """Item tokens in agreeing windows when item token i lies on text token i + ``shift``; 0: none."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    w = min(window, len(item))
    if high - low < w:
        return 0
    same = (item[low:high] == doc[low + shift : high + shift]).astype(np.int64)
    sums = np.cumsum(np.concatenate(([0], same)))
    good = np.flatnonzero(sums[w:] - sums[:-w] >= math.ceil(least * w - 1e-9))
    if not len(good):
        return 0
    cover = np.zeros(len(same), bool)
    for g in good:
        cover[g : g + w] = True
    return int(cover.sum())


def _verifier(frames):
    for f in frames:
        got = [max(agreement(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), s) for s in set(shifts)) for d, i, shifts in zip(f["tokens"], f["item"], f["shifts"])]
        yield pd.DataFrame({"key": f["key"], "item_key": f["item_key"], "overlap": got})


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, items, n_items, overlap)``: a row for each distinct contaminated text, by its MD5."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("text")).agg(F.min(item_id).alias("item_id")).withColumn("item_key", F.md5(F.col("text").cast("binary")))
    table = stage(items.select("item_key", "text").mapInPandas(_item_seeds, "seed long, at long, item_key string, item binary"), "seeds")
    bits = 1 << 16
    wanted = 512 * table.count()
    while bits < min(BLOOM_BITS, wanted):
        bits <<= 1
    parts = table.select("seed", (F.octet_length("item") / 8).cast("int").alias("length")).repartition(4).mapInPandas(_filler(bits), "bloom binary, lengths long").collect()  # 4 filters of 8 MB at most
    bloom, lengths = np.zeros(bits // 8, np.uint8), 0
    for p in parts:
        bloom |= np.frombuffer(p["bloom"], np.uint8)
        lengths |= p["lengths"]
    shared = spark.sparkContext.broadcast((bloom.tobytes(), bits, [n for n in range(WINDOW) if lengths >> n & 1]))
    keyed = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("text"))
    found = stage(keyed.mapInPandas(_finder(shared), "key string, tokens binary, seed array<long>, at array<long>"), "hits")
    hits = found.select("key", F.explode(F.arrays_zip("seed", "at")).alias("h")).select("key", F.col("h.seed").alias("seed"), F.col("h.at").alias("doc_at")).distinct()
    laid = hits.join(table.select("seed", "at", "item_key"), "seed").groupBy("key", "item_key").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("shifts"))
    pairs = laid.join(found.select("key", "tokens").dropDuplicates(["key"]), "key").join(table.select("item_key", "item").dropDuplicates(["item_key"]), "item_key")
    good = pairs.select("key", "item_key", "tokens", "item", "shifts").mapInPandas(_verifier, "key string, item_key string, overlap long").where("overlap > 0").join(items.select("item_key", "item_id"), "item_key")
    return stage(good.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_items"), F.max("overlap").alias("overlap")), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents."""
    key = free_name(docs, "_md5")
    bad = contaminated(docs, benchmark, text).select(F.col("key").alias(key))
    return docs.withColumn(key, F.md5(F.col(text).cast("binary"))).join(bad, key, "left_anti").drop(key)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: whether it is contaminated, by how many items, which, and the longest overlap in tokens."""
    bad = contaminated(docs, benchmark)
    own = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(bad, "key", "left")
    return own.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "items", "overlap").select("doc_id", "contaminated", "n_items", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def oracle() -> str:
    """The same result from every alignment of every item along every text, in DuckDB SQL."""
    words = r"regexp_extract_all(lower({}), '[^\x20\x09-\x0D!-/:-@\[-`{{-~]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, {words.format("text")} AS ts FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, {words.format("text")} AS ts FROM (SELECT text, min(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY text)),
dw AS (SELECT u, unnest(ts) AS w, unnest(range(len(ts))) AS p FROM d), iw AS (SELECT k, unnest(ts) AS w, unnest(range(len(ts))) AS q FROM i),
m AS (SELECT u, k, p - q AS s, list(q) AS qs FROM dw JOIN iw USING (w) GROUP BY u, k, p - q),
c AS (SELECT u, k, s, qs, least({WINDOW}, len(i.ts)) AS w, greatest(0, -s) AS low, least(len(i.ts), len(d.ts) - s) AS high FROM m JOIN d USING (u) JOIN i USING (k) WHERE len(qs) >= ceil({SIMILARITY} * least({WINDOW}, len(i.ts)) - 1e-9)),
g AS (SELECT * FROM (SELECT *, unnest(range(low, high - w + 1)) AS g FROM c WHERE high - low >= w) WHERE len(list_filter(qs, lambda q: q >= g AND q < g + w)) >= ceil({SIMILARITY} * w - 1e-9)),
o AS (SELECT u, k, max(n) AS n FROM (SELECT u, k, s, count(DISTINCT x) AS n FROM (SELECT u, k, s, unnest(range(g, g + w)) AS x FROM g) GROUP BY u, k, s) GROUP BY u, k),
r AS (SELECT u, count(*) AS n_items, array_to_string(list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)), ',') AS items, max(n) AS overlap FROM o JOIN i USING (k) GROUP BY u)
SELECT doc_id, r.u IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, CASE WHEN r.u IS NOT NULL THEN coalesce(items, '') END AS items, coalesce(overlap, 0)::BIGINT AS overlap FROM d LEFT JOIN r USING (u)"""
