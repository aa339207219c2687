"""WARC archives with a two-level capture index.

Writing: one gzip member per record, archives of about ``ROLL`` bytes.  Equal
payloads of ``REVISIT_BYTES`` or more are stored once, as the response of the
smallest page_id; the others are revisit records that refer to it.

Index: captures are sorted by reversed-host key and packed into gzip blocks of
``LINES`` lines (``index-*.gz``).  The directory keeps the first key, place and
size of each block, in one sorted file per index shard, and a top list keeps the
first key of each shard.  A lookup bisects the top list, then that shard's
directory, reads one byte range of the index, and then one of an archive.  A URL
with very many captures spreads over blocks and shards, for it is sorted by key
and page_id.

File names are fresh for each task attempt and count only through the committed
tables, so a lost executor's leftovers are never read.

Defined results: a null html is an empty payload; a null url has key ``-``; null
page_ids are never chosen as the response while another id is there; repeated
rows that share the smallest page_id are all responses; an empty table writes
no archive and reads back no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, small_batches, stage, workspace

REVISIT_BYTES, ROLL, LINES, DATE = 100, 64 << 20, 3000, "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, default ports and fragments dropped."""
    if not url:
        return "-"
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split("."))) if host else ""
    door = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{labels}{door}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC 1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers, payload)`` of one record; a revisit has no payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    body = rest[: int(head["Content-Length"])]
    return head, body.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    name = urn.rstrip(">").rsplit(":", 1)[1]
    return None if name == "None" else int(name)


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _archiver(folder: str):
    def run(batches):
        fs, where = open_fs(folder)
        out = name = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if out is None or out.tell() >= ROLL:
                    if out is not None:
                        out.close()
                    name = f"archive-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{where}/{name}", compression=None)
                payload = (r["html"] or "").encode()
                packed = gzip.compress(record(r["page_id"], r["url"], payload, r["digest"], r["first"], r["revisit"]), 6, mtime=0)
                rows.append({"key": surt(r["url"]), "page_id": r["page_id"], "file": name, "offset": out.tell(), "length": len(packed)})
                out.write(packed)
            yield pa.RecordBatch.from_pylist(rows, _CAPTURE)
        if out is not None:
            out.close()

    return run


def _indexer(folder: str):
    def run(batches):
        fs, where = open_fs(folder)
        held, directory, stem = [], [], uuid.uuid4().hex
        with fs.open_output_stream(f"{where}/index-{stem}.gz", compression=None) as out:

            def flush(lines):
                packed = gzip.compress("".join(x + "\n" for _, x in lines).encode(), 6, mtime=0)
                directory.append({"key": lines[0][0], "offset": out.tell(), "length": len(packed)})
                out.write(packed)

            last = None
            for b in batches:
                for r in b.to_pylist():
                    last = r["key"]
                    held.append((r["key"], f"{r['key']} {json.dumps([r['page_id'], r['file'], r['offset'], r['length']])}"))
                    if len(held) >= LINES:
                        flush(held)
                        held = []
            if held:
                flush(held)
        if directory:
            with fs.open_output_stream(f"{where}/directory-{stem}.json", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"key": directory[0]["key"], "last": last, "stem": stem, "blocks": len(directory)}])

    return run


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None, shard_rows: int = 1_000_000) -> tuple[str, DataFrame]:
    """Write archives and index; ``(folder URI, top list)``, a row for each index shard."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    folder = folder or workspace(spark, "warc")
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    told = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    captures = stage(told.select("page_id", "url", "html", "digest", "first", "revisit").mapInArrow(_archiver(folder), "key string, page_id long, file string, offset long, length long"), "captures")
    shards = max(1, -(-captures.count() // shard_rows))
    ranged = captures.repartitionByRange(shards, "key", "page_id", "file", "offset") if shards > 1 else captures.coalesce(1)
    return folder, stage(ranged.sortWithinPartitions("key", "page_id", "file", "offset").mapInArrow(_indexer(folder), "key string, last string, stem string, blocks long"), "top")


class Index:
    """The two-level index: ``shards`` is the sorted top list of ``(first key, last key, stem)``."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]):
        self.folder, self.shards = folder, sorted(shards)
        self.firsts = [x[0] for x in self.shards]
        self.fs = self.where = None
        self.directory: tuple[str, list[dict], list[str]] = ("", [], [])
        self.block: tuple = (None, [])

    def _range(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.where}/{name}") as f:
            f.seek(offset)
            return f.read(length)

    def _blocks(self, stem: str) -> tuple[list[dict], list[str]]:
        if self.directory[0] != stem:
            with self.fs.open_input_stream(f"{self.where}/directory-{stem}.json", compression=None) as f:
                rows = json.loads(f.read())
            self.directory = (stem, rows, [r["key"] for r in rows])
        return self.directory[1:]

    def blocks(self, key: str):
        """``(stem, offset, length)`` of each block that may hold captures of a key."""
        if self.fs is None:
            self.fs, self.where = open_fs(self.folder)
        at = max(0, bisect_left(self.firsts, key) - 1)
        while at < len(self.shards) and self.firsts[at] <= key:
            stem = self.shards[at][2]
            if key <= self.shards[at][1]:
                rows, keys = self._blocks(stem)
                for i in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
                    yield stem, rows[i]["offset"], rows[i]["length"]
            at += 1

    def captures(self, key: str, stem: str, offset: int, length: int) -> list[list]:
        """Captures ``[page_id, file, offset, length]`` of a key in one block."""
        if self.fs is None:
            self.fs, self.where = open_fs(self.folder)
        if self.block[0] != (stem, offset):
            text = zlib.decompress(self._range(f"index-{stem}.gz", offset, length), 31).decode()
            lines = [x.split(" ", 1) for x in text.split("\n")[:-1]]
            self.block = ((stem, offset), [x[0] for x in lines], [x[1] for x in lines])
        own = self.block[1]
        return [json.loads(x) for x in self.block[2][bisect_left(own, key) : bisect_right(own, key)]]

    def lookup(self, key: str) -> list[list]:
        """All captures ``[page_id, file, offset, length]`` of a key."""
        return [c for place in self.blocks(key) for c in self.captures(key, *place)]


_PLACE = pa.schema([("key", pa.string()), ("stem", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _seeker(shared):
    def run(batches):
        index = Index(*shared.value)
        for b in batches:
            rows = [dict(zip(_PLACE.names, (k, *place))) for k in b.column(0).to_pylist() for place in index.blocks(k)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PLACE)

    return run


def _block_reader(folder: str):
    def run(batches):
        index = Index(folder, [])
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = [dict(zip(_CAPTURE.names, (r["key"], *c))) for r in b.slice(at, 64).to_pylist() for c in index.captures(**r)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _CAPTURE)

    return run


def lookup(keys: DataFrame, folder: str, top: DataFrame) -> DataFrame:
    """Captures of distinct ``keys(key)``: bisection finds the blocks, which are then dealt out and read.

    A key with very many captures is many blocks, and so many tasks.
    """
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast((folder, [tuple(r) for r in top.select("key", "last", "stem").collect()]))  # a row for each million captures
    places = keys.sortWithinPartitions("key").mapInArrow(_seeker(shared), "key string, stem string, offset long, length long")
    dealt = places.repartition("stem", "offset").sortWithinPartitions("stem", "offset", "key")
    return dealt.mapInArrow(_block_reader(folder), "key string, page_id long, file string, offset long, length long")


def _fetcher(folder: str):
    def run(batches):
        fs, where = open_fs(folder)
        name = f = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["file"], fs.open_input_file(f"{where}/{r['file']}")
                f.seek(r["offset"])
                head, payload = parse(zlib.decompress(f.read(r["length"]), 31))
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                rows.append({"page_id": _page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": _page(head["WARC-Refers-To"]) if revisit else None, "payload_digest": digest, "payload": None if revisit else payload})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    return run


def fetch(captures: DataFrame, folder: str) -> DataFrame:
    """Records at ``captures(file, offset, length)``, read by byte range in archive order."""
    dealt = captures.repartition("file", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(_fetcher(folder), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def digest(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read every record back through the index: the contract's columns."""
    folder, top = write(pages)

    @F.pandas_udf("string")
    def key_of(urls: pd.Series) -> pd.Series:
        return urls.map(surt, na_action=None)

    keys = pages.select(key_of(F.col("url")).alias("key")).distinct()
    got = stage(fetch(lookup(keys, folder, top), folder).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "records")
    responses = got.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    origin = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").where("refers_to is not null").distinct()
    revisits = got.where("record_type = 'revisit'").drop("payload_bytes").join(origin, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits.select(*responses.columns))


def oracle() -> str:
    """The same result from the table itself, in DuckDB SQL."""
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


__all__ = ["Index", "digest", "fetch", "lookup", "oracle", "parse", "record", "surt", "write"]
