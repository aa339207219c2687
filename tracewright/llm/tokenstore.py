"""Token ids in files: frequency-ranked ids, byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (0: the most frequent), and a rank
is stored in 1 to 4 little-endian bytes.  Lengths stand apart from the bytes,
two bits a rank, four ranks a control byte; a block is decoded with numpy by
looking its control bytes up in a 256-row table.

A folder holds ``ranks.bin`` (id of each rank, u32) and ``shard-*.tok``, one
per range of doc_id.  A shard is a sequence of blocks::

    u32 documents, ids, data bytes | u8[documents] id is null |
    i64[documents] doc_id | u32[documents] ids of each | control | data

Documents are sorted once, as text; each range is tokenised by one task into a
spool file, ranks are counted over all spools, and the spools are then coded.
Files get fresh names and count only once their task has committed its manifest
row, so a task that runs again leaves no wrong file behind.

Defined results: a null text counts as empty and has the end id alone; null
doc_ids come first; repeated doc_ids are ordered by text; an empty table writes
``ranks.bin`` alone and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, open_fs, small_batches, stage, workspace

SHARD_BYTES, BLOCK_IDS, CACHE, LONGEST = 16 << 20, 1 << 19, 700_000, 48
#: White space that cutting at spaces does not foresee, or that libraries see differently.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

# ---- the code ---------------------------------------------------------------

#: Row c: the lengths of the four ranks that control byte c describes; their starts; which of 16 bytes are filled.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
FILLED = np.array([[b < n for n in row for b in range(4)] for row in LENGTHS], bool)
TOTALS = LENGTHS.sum(axis=1, dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """``(control, data)`` of unsigned 32-bit ranks."""
    n = -(-len(ranks) // 4) * 4
    full = np.zeros(n, "<u4")
    full[: len(ranks)] = ranks
    code = (full > 0xFF).astype(np.uint8) + (full > 0xFFFF) + (full > 0xFFFFFF)
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), full.view(np.uint8).reshape(-1, 16)[FILLED[control]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of :func:`pack`."""
    rows = np.frombuffer(control, np.uint8)
    out = np.zeros((len(rows), 16), np.uint8)
    out[FILLED[rows]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


def _write_block(f, ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    f.write(struct.pack("<III", len(ids), len(ranks), len(data)))
    f.write(np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes())
    f.write(control + data)


def read_blocks(f):
    """``(doc_ids, lengths, ranks)`` of each block of an open shard."""
    while head := f.read(12):
        docs, n, size = struct.unpack("<III", head)
        none = np.frombuffer(f.read(docs), np.uint8)
        ids = [None if x else i for i, x in zip(np.frombuffer(f.read(8 * docs), "<i8").tolist(), none)]
        lengths = np.frombuffer(f.read(4 * docs), "<u4")
        control = f.read(-(-n // 4))
        yield ids, lengths, unpack(control, f.read(size), n)


# ---- the tokenizer ------------------------------------------------------------


class Encoder:
    """Texts to little-endian ids with the tokenizers library.

    A byte-level BPE always splits a text before a space that follows another
    character, between a letter and punctuation, and after a lone line end.
    Texts are cut there with numpy, equal pieces are found by a 64-bit key and
    confirmed by all their bytes, and each distinct piece is encoded once and remembered
    (twice ``CACHE`` short pieces at most, the least used half leaving first).
    Where two pieces differ but share a key, the round's texts are encoded
    whole, and so are texts with rarer white space or an added token's string,
    and all texts of any other kind of tokenizer.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self.tokenizer.to_str())
        kind = pre.get("pre_tokenizer") or {}
        self.pieces = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not pre.get("normalizer") and not any(set(t["content"]) & set(" \t\r\n") or t["lstrip"] or t["rstrip"] for t in pre["added_tokens"])
        self.added = [t["content"] for t in pre["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2048):  # the library's result objects are large
            made = [array(self.code, e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)]
            if sys.byteorder == "big":
                for x in made:
                    x.byteswap()
            out += [x.tobytes() for x in made]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return self._whole(texts)
        odd = [bool(_ODD.search(t)) or any(x in t for x in self.added) for t in texts]
        raws = [b"" if o else t.encode("utf-8", "surrogatepass") for o, t in zip(odd, texts)]
        out, part, size = [], [], 0
        for r in raws:  # rounds of about _LONG bytes
            part.append(r if len(r) < _LONG else b"")
            size += len(part[-1])
            if size >= _LONG // 2:
                out += self._cut(part)
                part, size = [], 0
        out += self._cut(part)
        for i, (o, r) in enumerate(zip(odd, raws)):
            if o:
                out[i] = self._whole([texts[i]])[0]
            elif len(r) >= _LONG:  # too long for one round: cut at a border
                out[i] = b"".join(x for p in _slices(r) for x in self._cut([p]))
        return out

    def _cut(self, raws: list[bytes]) -> list[bytes]:
        at = np.cumsum([0, *map(len, raws)])
        if not at[-1]:
            return [b""] * len(raws)
        buf = b"".join([*raws, bytes(8)])
        a = np.frombuffer(buf, np.uint8, int(at[-1]))
        space = _SPACE[a]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[at[:-1][at[:-1] < len(a)]] = True
        line = start[:-1] & (a[:-1] == 10) & ~space[1:]
        mark = _MARK[a]
        start[1:] |= line | (mark[1:] & _LETTER[a[:-1]])
        two_byte = (a[:-2] >= 0xC3) & (a[:-2] <= 0xC8) & ~((a[:-2] == 0xC3) & ((a[1:-1] == 0x97) | (a[1:-1] == 0xB7)))  # U+00C0 to U+023F without the signs for times and division
        start[2:] |= mark[2:] & two_byte
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(a))
        keys, head, tail = _keys(buf, s, e)
        of, values = pd.factorize(keys)
        first = np.empty(len(values), np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        if not _same(buf, s, e, head, tail, first[of]):  # two pieces share a key
            return self._whole([r.decode("utf-8", "surrogatepass") for r in raws])
        pieces = [buf[x:y] for x, y in zip(s[first].tolist(), e[first].tolist())]
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        coded = list(map(self.known.get, pieces))
        missing = [i for i, c in enumerate(coded) if c is None]
        for i in missing:
            if (c := self.older.get(pieces[i])) is not None:
                coded[i] = self.known[pieces[i]] = c
        missing = [i for i in missing if coded[i] is None]
        new = [pieces[i] for i in missing]
        found = self._whole([p.decode("utf-8", "surrogatepass") for p in new])
        self.known.update(zip(new, found))
        for i, c in zip(missing, found):
            coded[i] = c
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        n = np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize
        begin, many = (np.cumsum(n) - n)[of], n[of]
        ends = np.cumsum(many)
        flat = np.frombuffer(b"".join(coded), self.kind)[np.repeat(begin - ends + many, many) + np.arange(ends[-1])].tobytes()
        cuts = (np.append(0, ends)[np.searchsorted(s, at)] * self.kind.itemsize).tolist()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:])]


_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_MARK = np.array([chr(c) in ".,;:!?()|%#$*" for c in range(256)])
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG = 1 << 21


def _slices(raw: bytes):
    """A long text in parts that end before a space after another character."""
    border = re.compile(rb"(?<=[^ \t\n\r])(?=[ \t\n\r])")
    at = 0
    while at < len(raw):
        m = border.search(raw, at + _LONG // 2)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end


def _keys(buf: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, first 8 bytes, last 8 bytes)`` of the byte ranges; ``buf`` goes on for 8 bytes after the last.

    Up to 7 bytes the key is the bytes and their number.  Up to 16 it mixes the
    first and last 8 with the number; beyond, it is a hash of all bytes.
    """
    from xxhash import xxh64_intdigest

    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    n = e - s
    size = np.minimum(n, 8)
    head = words[s] & _FIRST[size]
    keys = head | n.astype(np.uint64) << np.uint64(56)
    tail = np.zeros_like(head)
    more = np.flatnonzero(n > 7)
    tail[more] = words[e[more] - 8]
    spread = np.uint64(0x9E3779B97F4A7C15)
    mixed = (head[more] + n[more].astype(np.uint64)) * spread
    mixed ^= mixed >> np.uint64(32)
    keys[more] = mixed * np.uint64(0xC2B2AE3D27D4EB4F) ^ tail[more]
    keys *= spread  # one to one, so the keys of short ranges stay distinct
    keys ^= keys >> np.uint64(32)
    for i in np.flatnonzero(n > 16).tolist():
        keys[i] = xxh64_intdigest(buf[s[i] : e[i]])
    return keys, head, tail


def _same(buf: bytes, s: np.ndarray, e: np.ndarray, head: np.ndarray, tail: np.ndarray, to: np.ndarray) -> bool:
    """Whether each byte range equals the range numbered ``to`` of it."""
    n = e - s
    if (n != n[to]).any() or (head != head[to]).any() or (tail != tail[to]).any():
        return False
    long = np.flatnonzero((n > 16) & (to != np.arange(len(to)))).tolist()
    return all(buf[s[i] : e[i]] == buf[s[j] : e[j]] for i, j in zip(long, to[long].tolist()))


# ---- the steps ------------------------------------------------------------------


def _spooler(folder: str, path: str, end_id: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        enc, squeeze = Encoder.of(path), zstandard.ZstdCompressor(-3)
        end = np.array([end_id], enc.kind).tobytes()
        counts, docs, total = np.zeros(enc.vocabulary, np.int64), 0, 0
        fs, where = open_fs(folder)
        name = f"spool-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{where}/spools/{name}") as f:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for at in range(0, len(ids), 512):
                    coded = [x + end for x in enc.encode([t or "" for t in texts[at : at + 512]])]
                    flat = np.frombuffer(b"".join(coded), enc.kind)
                    counts += np.bincount(flat, minlength=enc.vocabulary)
                    part = ids[at : at + 512]
                    body = squeeze.compress(np.array([i is None for i in part], np.uint8).tobytes() + np.array([i or 0 for i in part], "<i8").tobytes() + np.array([len(x) // enc.kind.itemsize for x in coded], "<u4").tobytes() + flat.tobytes())
                    f.write(struct.pack("<II", len(part), len(body)) + body)
                    docs, total = docs + len(part), total + len(flat)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["shard", "spool", "docs", "tokens", "counts"])

    return run


def _count(batches):
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            got = np.frombuffer(zlib.decompress(x), np.int64)
            total = got.copy() if total is None else total + got
    if total is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])


def _coder(folder: str, path: str):
    def run(batches):
        import zstandard

        enc, loose = Encoder.of(path), zstandard.ZstdDecompressor()
        fs, where = open_fs(folder)
        with fs.open_input_stream(f"{where}/ranks.bin") as f:
            ids_of = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(enc.vocabulary, np.uint32)
        rank[ids_of] = np.arange(len(ids_of), dtype=np.uint32)
        for b in batches:
            for row in b.to_pylist():
                name, size = f"shard-{row['shard']:06d}-{uuid.uuid4().hex}.tok", 0
                with fs.open_input_stream(f"{where}/spools/{row['spool']}") as src, fs.open_output_stream(f"{where}/{name}") as out:
                    ids, lengths, ranks, held = [], [], [], 0
                    while head := src.read(8):
                        docs, packed = struct.unpack("<II", head)
                        body = loose.decompress(src.read(packed))
                        none, at = np.frombuffer(body, np.uint8, docs), docs
                        ids += [None if x else i for i, x in zip(np.frombuffer(body, "<i8", docs, at).tolist(), none)]
                        lengths += np.frombuffer(body, "<u4", docs, at + 8 * docs).tolist()
                        ranks.append(rank[np.frombuffer(body, enc.kind, -1, at + 12 * docs)])
                        held += len(ranks[-1])
                        if held >= BLOCK_IDS:
                            _write_block(out, ids, lengths, np.concatenate(ranks))
                            ids, lengths, ranks, held = [], [], [], 0
                    if ids:
                        _write_block(out, ids, lengths, np.concatenate(ranks))
                    size = out.tell()
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "file": name, "docs": row["docs"], "tokens": row["tokens"], "first": row["first"], "bytes": size}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("bytes", pa.int64())]))

    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the files; ``(folder URI, manifest)``, a manifest row for each shard.

    ``path``: the tokenizer's file, at the same place on every executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or workspace(spark, "tokens")
    fs, where = open_fs(folder)
    fs.create_dir(f"{where}/spools", recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = rows.repartitionByRange(shards, order[0], F.xxhash64("text")) if shards > 1 else rows.coalesce(1)
    spools = stage(ranged.sortWithinPartitions(order[0], F.xxhash64("text"), order[1]).mapInArrow(_spooler(folder, path, end_id), "shard int, spool string, docs long, tokens long, counts binary"), "spools")
    counts = spools.select("counts").repartition(min(64, shards)).mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = counts.orderBy(F.desc("n"), "id").select("id").toPandas()["id"]  # at most one row for each id of the vocabulary
    with fs.open_output_stream(f"{where}/ranks.bin") as f:
        f.write(np.asarray(ranks, "<u4").tobytes())
    first = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = spools.drop("counts").withColumn("first", first).repartition(shards)
    manifest = stage(listed.mapInArrow(_coder(folder, path), "shard int, file string, docs long, tokens long, first long, bytes long"), "manifest")
    fs.delete_dir(f"{where}/spools")
    discard(spark, spools)
    return folder, manifest


def _reader(folder: str):
    def run(batches):
        fs, where = open_fs(folder)
        with fs.open_input_stream(f"{where}/ranks.bin") as f:
            ids_of = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for row in b.to_pylist():
                at = row["first"]
                with fs.open_input_stream(f"{where}/{row['file']}") as f:
                    for ids, lengths, ranks in read_blocks(f):
                        tokens = ids_of[ranks]
                        ends = np.cumsum(lengths, dtype=np.int64)
                        starts = ends - lengths
                        sums = [zlib.crc32(tokens[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + at), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])

    return run


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, decoded from the files."""
    n = max(1, manifest.count())
    return manifest.select("file", "first").repartition(n).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` and read the files back: the contract's columns."""
    folder, manifest = write(docs, path)
    return read(docs.sparkSession, folder, manifest)
