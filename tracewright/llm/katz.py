"""Katz backoff language model: trigram over bigram over unigram.

    P(w | u, v) = d3(c) c(u, v, w) / C(u, v)  if the triple was seen twice or more
                = alpha(u, v) P(w | v)        otherwise
    P(w | v)    = d2(c) c(v, w) / C(v)        if the pair was seen
                = alpha(v) P(w)               otherwise
    P(w)        = (c(w) + 0.1) / (N + 0.1 (V + 1)),  one class for all unknown words

The d(c) are Good-Turing discounts for counts up to ``K``; an alpha gives what the
seen continuations of a context leave over to all others, so each context sums to
1 exactly.  A context whose discounts leave nothing keeps half a count back.
Triples seen once are given up to the backoff, as Katz proposed, so d3(1) is 0;
their number still enters the discounts.  A text's first token has one start mark
as its history and is scored by the pair.  ``order`` 2 leaves the triples out.

Tables are dealt by the range of a 64-bit hash (``buckets``) and packed: a row
holds a bucket's sorted keys and 64-bit counts.  Texts stay in spool files of about
``SPOOL_BYTES`` of text.  A spool asks each bucket for its distinct words and
pairs, then for its contexts and for the triples of which both pairs were seen
twice (no other can have been), then for the contexts of those; a bucket merges
all requests and answers each spool.  So a frequent word costs one entry a spool,
whatever its count, and no word, pair or context gathers in one task.  A spool
sends a bucket one message or none, so messages grow with the square of the input
only until each holds a single key; from there on they are what a plain shuffle
of partially summed keys would be.

Defined results: a null text is empty and has the end token alone; null ids
count as the empty text in the fold; repeated rows each count; without training
text every word is unknown with probability 1; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, open_fs, small_batches, stage, workspace

SPOOL_BYTES, K, FIRST, BUCKET_BYTES = 16 << 20, 5, 0.1, 10 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of word-hash pairs."""
    h = (v ^ (v >> np.uint64(31))) * _MIX + w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def discounts(n: list[int], k: int = K, least: int = 1) -> np.ndarray:
    """d(0..k+1) from the numbers ``n[r]`` of n-grams seen r times, r up to k + 1; above k no discount, below ``least`` 0."""
    out = np.ones(k + 2)
    out[:least] = 0
    top = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(least, k + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        d = (star / r - top) / (1 - top) if top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


# ---- packing: differences of sorted keys, and byte planes, compress well ----


def _pack(x: np.ndarray, diff: bool = False) -> bytes:
    if diff and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(raw: bytes, kind: str, diff: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=np.uint64) if diff else x


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted keys."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _small(raw: bytes) -> bytes:
    """A message's part compressed; byte planes of small numbers shrink more here than in Spark's shuffle."""
    return _zstd()[0].compress(raw)


def _large(raw: bytes) -> bytes:
    return _zstd()[1].decompress(raw)


_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("spool", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
_ASK_SQL = "kind int, bucket int, spool long, keys binary, vals binary"
_SAY = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("spool", pa.int64()), ("vals", pa.binary()), ("keys", pa.binary()), ("stats", pa.list_(pa.int64()))])
_SAY_SQL = "kind int, bucket int, spool long, vals binary, keys binary, stats array<long>"


def _ask(kind: int, spool: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.Table:
    """Request rows for sorted keys; each column's slice follows the one before."""
    cut = _cuts(keys, buckets)
    rows = [{"kind": kind, "bucket": b, "spool": spool, "keys": _small(_pack(keys[s:e], True)), "vals": _small(b"".join(_pack(c[s:e]) for c in columns))} for b, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if e > s]
    return pa.Table.from_pylist(rows, _ASK)


def _gathered(table: pa.Table, kinds: list[str]):
    """``(rows, ends, keys, columns)`` of a bucket's requests, by spool."""
    rows = sorted(table.to_pylist(), key=lambda r: r["spool"])
    keys = [_unpack(_large(r["keys"]), "<u8", True) for r in rows]
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for r, k in zip(rows, keys):
        at, vals = 0, _large(r["vals"])
        for c, kind in zip(columns, kinds):
            size = len(k) * np.dtype(kind).itemsize
            c.append(_unpack(vals[at : at + size], kind))
            at += size
    return rows, np.cumsum([len(k) for k in keys])[:-1], np.concatenate(keys), [np.concatenate(c) for c in columns]


def _answer(rows: list[dict], ends: np.ndarray, columns: list[np.ndarray], table: tuple, stats: list[int]) -> pa.Table:
    split = [np.split(c, ends) for c in columns]
    out = [{"kind": r["kind"], "bucket": r["bucket"], "spool": r["spool"], "vals": _small(b"".join(_pack(c[i]) for c in split))} for i, r in enumerate(rows)]
    out.append({"kind": -rows[0]["kind"], "bucket": rows[0]["bucket"], "keys": table[0], "vals": table[1], "stats": stats})
    return pa.Table.from_pylist(out, _SAY)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct keys in order, one place of each, number of each key's entry)``."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[order[new]], order[new], of


# ---- spools -------------------------------------------------------------------


class _Spool:
    """Distinct word hashes (the start mark among them), the words of each text, and the texts' ids."""

    def __init__(self, folder: str, name: int):
        import zstandard

        fs, where = open_fs(folder)
        with fs.open_input_stream(f"{where}/{name:016x}", compression=None) as f:
            raw = zstandard.ZstdDecompressor().decompress(f.read())
        u, n, docs = struct.unpack("<III", raw[:12])
        at = 12
        self.uniq = _unpack(raw[at : (at := at + 8 * u)], "<u8", True)
        self.of = _unpack(raw[at : (at := at + 4 * n)], "<u4").view("<i4")
        self.lengths = np.frombuffer(raw[at : (at := at + 4 * docs)], "<u4").astype(np.int64)
        self.held = np.frombuffer(raw[at : (at := at + docs)], np.uint8).astype(bool)
        none = np.frombuffer(raw[at : (at := at + docs)], np.uint8)
        self.ids = [None if x else i for i, x in zip(np.frombuffer(raw[at:], "<i8").tolist(), none)]
        self.train = np.repeat(~self.held, self.lengths)

        self.starts = np.cumsum(self.lengths) - self.lengths
        self.end = int(np.searchsorted(self.uniq, np.uint64(_hash(b""))))

    def pairs(self):
        """``(keys, context, word, place of each token, count in training)`` of the distinct pairs, by key."""
        return _pairs(self.uniq, self.of, self.starts, self.train)

    def triples(self, keys: np.ndarray, place: np.ndarray, c2: np.ndarray):
        """``(keys, context pair, last pair, tokens, place of each of these tokens, count in training)`` of triples whose pairs were both seen twice."""
        often = c2[place] >= 2
        often[1:] &= often[:-1]
        often[self.starts] = False
        token = np.flatnonzero(often)
        own, at, of = _grouped(pair_keys(keys[place[token - 1]], self.uniq[self.of[token]]))
        count = np.bincount(of[self.train[token]], minlength=len(own)).astype("<u4")
        return own, place[token[at] - 1], place[token[at]], token, of, count


def _pairs(uniq: np.ndarray, of: np.ndarray, starts: np.ndarray, train: np.ndarray):
    before = np.empty_like(of)
    before[1:] = of[:-1]
    before[starts] = int(np.searchsorted(uniq, np.uint64(_hash(b" "))))
    keys, at, place = _grouped(pair_keys(uniq[before], uniq[of]))
    return keys, before[at], of[at], place, np.bincount(place[train], minlength=len(keys)).astype("<u4")


def _spooler(folder: str, buckets: int):
    def run(batches):
        import zstandard

        fs, where = open_fs(folder)
        known: dict[bytes, int] = {}
        end, start = _hash(b""), _hash(b" ")
        ids, held, lengths, flat, size = [], [], [], [], 0

        def flush():
            nonlocal ids, held, lengths, flat, size
            uniq, _, of = _grouped(np.concatenate([*flat, np.array([start], np.uint64)]))
            of = of[:-1]
            train = np.repeat(~np.array(held, bool), lengths)
            count = np.bincount(of[train], minlength=len(uniq)).astype("<u4")
            raw = struct.pack("<III", len(uniq), len(of), len(ids)) + _pack(uniq, True) + _pack(of.astype("<u4")) + np.array(lengths, "<u4").tobytes() + np.array(held, np.uint8).tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
            name = uuid.uuid4().int >> 65
            with fs.open_output_stream(f"{where}/{name:016x}", compression=None) as f:
                f.write(zstandard.ZstdCompressor(6).compress(raw))
            many = np.array(lengths)
            ids, held, lengths, flat, size = [], [], [], [], 0
            yield from _ask(1, name, uniq, [count], buckets).to_batches()
            keys, _, _, _, count = _pairs(uniq, of, np.cumsum(many) - many, train)
            yield from _ask(2, name, keys, [count], buckets).to_batches()

        for b in batches:
            for i, text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = words(text)
                got = []
                for w in own:
                    x = known.get(w)
                    if x is None:
                        x = known[w] = _hash(w)
                    got.append(x)
                got.append(end)
                flat.append(np.array(got, np.uint64))
                ids.append(i)
                held.append(h)
                lengths.append(len(got))
                size += len(text or "") + 64
                if len(known) > 300_000:
                    known.clear()
                if size >= SPOOL_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _words_merged(table: pa.Table) -> pa.Table:
    rows, ends, keys, (count,) = _gathered(table, ["<u4"])
    uniq, _, of = _grouped(keys)
    total = np.bincount(of, weights=count).astype("<u8")
    seen = total > 0
    return _answer(rows, ends, [total[of]], (_pack(uniq[seen], True), _pack(total[seen])), [int(seen.sum()), int(total.sum())])


def _grams_merged(least: int):
    """Counts of pairs or triples, those below ``least`` as 0, and which spool speaks for each; statistics: how many were seen 0 to K + 1 times, and the sum of the counts kept."""

    def run(table: pa.Table) -> pa.Table:
        rows, ends, keys, (count,) = _gathered(table, ["<u4"])
        uniq, _, of = _grouped(keys)
        total = np.bincount(of, weights=count).astype("<u8")
        total[total < least] = 0
        owner = np.zeros(len(keys), np.uint8)
        some = np.flatnonzero((count > 0) & (total[of] > 0))
        owner[some[np.unique(of[some], return_index=True)[1]]] = 1
        seen = total > 0
        low = np.bincount(np.minimum(total[seen], K + 2).astype(np.int64), minlength=K + 3)
        return _answer(rows, ends, [total[of], owner], (_pack(uniq[seen], True), _pack(total[seen])), [*low[: K + 2].tolist(), int(total.sum())])

    return run


_SUMS = ["<u8"] * (K + 3) + ["u1"]  # of a word as context: tokens, pairs seen 1 to K times, successors, their own counts, whether the spool needs alpha


def _contexts_merged(n: int, v: int, d: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        rows, ends, keys, sums = _gathered(table, _SUMS)
        uniq, _, of = _grouped(keys)
        count, *low, followers, own = (np.bincount(of, weights=x) for x in sums[:-1])
        kept = count + sum((d[r] - 1) * r * x for r, x in enumerate(low, 1))
        mass = (own + FIRST * followers) / (n + FIRST * (v + 1))
        size, alpha = _left(count, kept, mass)
        some = count > 0
        return _answer(rows, ends, [size[of], alpha[of] * sums[-1]], (_pack(uniq[some], True), _pack(size[some]) + _pack(alpha[some])), [])

    return run


def _left(count: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and alphas from contexts' counts, what the discounts keep of them, and the lower order's mass of the seen words."""
    size = np.where(kept >= count, count + 0.5, count)
    left = np.where(count > 0, (size - kept) / np.maximum(size, 0.5), 1.0)
    return size, np.where(count > 0, left / np.maximum(1 - mass, 1e-300), 1.0)


_SUMS3 = ["<u8", "<f8", "<f8", "u1"]  # of a pair as context: its count if the spool speaks for a triple, what is kept of it, the mass of the seen words, whether the spool needs the answer


def _contexts3_merged(table: pa.Table) -> pa.Table:
    rows, ends, keys, (count, kept, mass, need) = _gathered(table, _SUMS3)
    uniq, _, of = _grouped(keys)

    def total(x: np.ndarray) -> np.ndarray:  # in the order of the addends, so that reruns agree
        order = np.lexsort((x, of))
        return np.bincount(of[order], weights=x[order])

    kept, mass = total(kept), total(mass)
    most = np.zeros(len(uniq), "<u8")
    np.maximum.at(most, of, count)
    size, alpha = _left(most.astype(float), kept, mass)
    some = kept > 0
    alpha[~some] = 1.0
    return _answer(rows, ends, [size[of] * need, alpha[of] * need], (_pack(uniq[some], True), _pack(size[some]) + _pack(alpha[some])), [])


def _merged(by_kind: dict):
    def run(table: pa.Table) -> pa.Table:
        return by_kind[table.column("kind")[0].as_py()](table)

    return run


def _said(rows: list[dict], kind: int, kinds: list[str]) -> list[np.ndarray]:
    """One spool's answers of a kind, in the order of its sorted keys."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    width = sum(np.dtype(k).itemsize for k in kinds)
    for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"]):
        vals = _large(r["vals"])
        n, at = len(vals) // width, 0
        for p, k in zip(parts, kinds):
            size = n * np.dtype(k).itemsize
            p.append(_unpack(vals[at : at + size], k))
            at += size
    return [np.concatenate([np.zeros(0, k), *p]) for k, p in zip(kinds, parts)]


class _Known:
    """A spool with what the buckets have said about it so far."""

    def __init__(self, folder: str, table: pa.Table):
        rows = table.to_pylist()
        self.name = rows[0]["spool"]
        self.spool = _Spool(folder, self.name)
        (self.c1,) = _said(rows, 1, ["<u8"])
        self.c2, owner = _said(rows, 2, ["<u8", "u1"])
        self.owner2 = owner.view(bool)
        self.rows = [r for r in rows if r["kind"] > 2]
        del rows, table
        self.keys, self.ctx, self.word, self.place, _ = self.spool.pairs()

    def p2(self, n: int, v: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the distinct words, and of the distinct pairs' words after their contexts."""
        p1 = (self.c1 + FIRST) / (n + FIRST * (v + 1))
        size, alpha = _said(self.rows, 3, ["<f8", "<f8"])
        p = np.maximum(alpha[self.ctx], 1e-300) * p1[self.word]
        seen = self.c2 > 0
        p[seen] = self.c2[seen] * d[np.minimum(self.c2[seen], K + 1).astype(int)] / size[self.ctx[seen]]
        return p1, p

    def third(self) -> None:
        """Place the triples: the pairs that begin and end them, their counts, the count and context of each token, and the pairs that ask as contexts.

        A pair asks if this spool speaks for one of its triples, or needs its
        answer: a token after it backs off, or all triples that are seen here
        have no discount, so that half a count may have been kept back.
        """
        _, self.before3, self.last3, token, of, _ = self.spool.triples(self.keys, self.place, self.c2)
        count, owner = _said(self.rows, 4, ["<u8", "u1"])
        self.count3, self.owner3 = count, owner.view(bool)
        self.c3 = np.zeros(len(self.place), "<u8")
        self.c3[token] = count[of]
        self.context = np.append(np.int32(-1), self.place[:-1])
        self.context[self.spool.starts] = -1
        self.context[(self.context >= 0) & (self.c2[self.context] < 2)] = -1
        n = len(self.keys)
        marked = lambda where: np.bincount(self.context[where], minlength=n) > 0
        after = self.context >= 0
        self.need = marked(after & (self.c3 == 0)) | (marked(after & (self.c3 > K)) & ~marked(after & (self.c3 > 0) & (self.c3 <= K)))
        self.speaks = np.bincount(self.before3[self.owner3], minlength=n) > 0
        self.asks = np.flatnonzero(self.need | self.speaks)


def _ask_contexts(folder: str, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        k = _Known(folder, table)
        c, ctx, follower = k.c2[k.owner2], k.ctx[k.owner2], k.c1[k.word[k.owner2]]
        total = lambda x: np.bincount(ctx, weights=x, minlength=len(k.spool.uniq))
        sums = [total(x).astype(t) for x, t in zip([c, *(c == r for r in range(1, K + 1)), np.ones(len(c)), follower], _SUMS)]
        need = np.bincount(k.ctx[k.c2 == 0], minlength=len(k.spool.uniq)) > 0
        return _ask(3, k.name, k.spool.uniq, [*sums, need.astype(np.uint8)], buckets)

    return run


def _ask_triples(folder: str, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        k = _Known(folder, table)
        keys, *_, count = k.spool.triples(k.keys, k.place, k.c2)
        return _ask(4, k.name, keys, [count], buckets)

    return run


def _ask_contexts3(folder: str, buckets: int, n: int, v: int, d2: np.ndarray, d3: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        k = _Known(folder, table)
        k.third()
        c, ctx, last = k.count3[k.owner3], k.before3[k.owner3], k.last3[k.owner3]
        total = lambda x: np.bincount(ctx, weights=x, minlength=len(k.keys))[k.asks]
        return _ask(5, k.name, k.keys[k.asks], [(k.c2 * k.speaks)[k.asks], total(c * d3[np.minimum(c, K + 1).astype(int)]), total(k.p2(n, v, d2)[1][last]), k.need[k.asks].astype(np.uint8)], buckets)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(folder: str, n: int, v: int, d2: np.ndarray, d3: np.ndarray | None):
    def run(table: pa.Table) -> pa.Table:
        k = _Known(folder, table)
        spool = k.spool
        p1, p2 = k.p2(n, v, d2)
        score = np.log10(p2)[k.place]
        if d3 is not None:
            k.third()
            size, alpha = np.maximum(k.c2.astype(float), 1), np.ones(len(k.keys))
            of_needed = k.need[k.asks]
            size[k.need], alpha[k.need] = (x[of_needed] for x in _said(k.rows, 5, ["<f8", "<f8"]))
            back = np.flatnonzero((k.context >= 0) & (k.c3 == 0))
            score[back] += np.log10(np.maximum(alpha[k.context[back]], 1e-300))
            seen = np.flatnonzero(k.c3)
            score[seen] = np.log10(k.c3[seen] * d3[np.minimum(k.c3[seen], K + 1).astype(int)] / size[k.context[seen]])
        add = lambda x: np.add.reduceat(x, spool.starts)
        return pa.Table.from_arrays([pa.array(spool.ids, pa.int64()), pa.array(spool.held), pa.array(spool.lengths), pa.array(add((k.c1[spool.of] > 0).astype(np.int64))), pa.array(np.full(len(spool.ids), n, np.int64)), pa.array(add(np.log10(p1)[spool.of])), pa.array(add(score))], schema=_SCORED)

    return run


def _totals(said: DataFrame, kind: int) -> list[int]:
    """The buckets' statistics of a kind, added up."""
    got = said.where(F.col("kind") == -kind).select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row for each statistic
    return [r["x"] for r in sorted(got)]


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(scores, tables)``: a row per document, and the model's packed tables.

    ``tables(kind, bucket, keys, vals)``: kind 1 words (counts), 2 pairs
    (counts), 3 words as contexts (denominator and alpha), 4 triples (counts), 5
    pairs as contexts (denominator and alpha; pairs not listed have alpha 1).
    Learns from the rows where ``held_out`` does not hold.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    folder = workspace(spark, "katz")
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size, learned = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0))).first()
    buckets = max(8, -(-size // BUCKET_BYTES))
    merge = lambda ask, by_kind, label: stage(ask.groupBy("kind", "bucket").applyInArrow(_merged(by_kind), _SAY_SQL), label)
    first = merge(rows.mapInArrow(_spooler(folder, buckets), _ASK_SQL), {1: _words_merged, 2: _grams_merged(1)}, "grams")
    v, n = _totals(first, 1) or (0, 0)
    d2 = discounts((_totals(first, 2) or [0] * (K + 3))[: K + 2])
    parts = [first]
    tasks = max(1, first.where("kind = 1").select("spool").distinct().count())  # set, since adaptive execution would read a few names as one small task
    narrow = ["kind", "bucket", "spool", "vals"]

    def asked(run, schema: str) -> DataFrame:
        known = reduce(DataFrame.unionByName, [p.where("kind > 0").select(narrow) for p in parts])
        return known.repartition(tasks, "spool").groupBy("spool").applyInArrow(run, schema)

    contexts = merge(asked(_ask_contexts(folder, buckets), _ASK_SQL), {3: _contexts_merged(n, v, d2)}, "contexts")
    d3 = None
    if order == 2:
        parts.append(contexts)
    else:
        triples = merge(asked(_ask_triples(folder, buckets), _ASK_SQL), {4: _grams_merged(2)}, "triples")
        parts += [contexts, triples]
        low = _totals(parts[-1], 4) or [0] * (K + 3)
        low[1] = n - learned - low[-1]  # all other triples were seen once
        d3 = discounts(low[: K + 2], least=2)
        parts.append(merge(asked(_ask_contexts3(folder, buckets, n, v, d2, d3), _ASK_SQL), {5: _contexts3_merged}, "contexts3"))
    scored = asked(_score(folder, n, v, d2, d3), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    tables = reduce(DataFrame.unionByName, parts).where("kind < 0").select((-F.col("kind")).alias("kind"), "bucket", "keys", "vals")
    return scored, tables


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, crc_fold("doc_id", 10) == 0)[0]


__all__ = ["digest", "discounts", "pair_keys", "score", "words"]
