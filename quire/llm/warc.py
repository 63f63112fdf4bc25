"""WARC archives and a two-level capture index.

Pages become records of gzip-compressed archives: a response with the payload, or a revisit of the response whose payload
is the same. The captures, sorted by reversed-host key, are cut into compressed blocks; of each block a sparse directory
holds the first key and the place. A lookup searches the directory by halves, reads one block by its range, searches that
by halves, and reads the record by its range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import qualified, shared_open, shared_path, written

MIN_REVISIT = 100  # bytes of the smallest payload that is not archived again
BLOCK = 2000  # captures of a block of the index
FILE_BYTES = 1 << 30  # an archive that has grown so large is followed by another
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The reversed-host key of a URL: com,example,www)/path?query. Scheme, user, port and fragment don't count; a URL
    without a scheme is all path, null the empty key."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(whole, pattern, 1))
    rest = F.when(F.regexp_like(whole, F.lit(pattern)), F.regexp_extract(whole, pattern, 2)).otherwise(F.split_part(whole, F.lit("#"), F.lit(1)))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _line(value: str) -> str:
    """A header's value: control characters, which would end it, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record of its own gzip member: a revisit of refers_to, or with None a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    heads = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id) if page_id is not None else '<' + uuid.uuid4().urn + '>'}", f"WARC-Date: {DATE}"]
    if url is not None:
        heads.append(f"WARC-Target-URI: {_line(url)}")
    heads.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block = http + payload
    else:
        heads += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
        block = http
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (None for revisits) of a record; its
    lengths and the digest of a response's payload are verified."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if lines[0] != "WARC/1.1" or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {lines[:3]}")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")) else None
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its record says")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": length, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if response else None}


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: a response) of every row of pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= min_revisit)
    # one row for each payload that stands more than once; the join below meets it as a table, so that Spark can split hot payloads
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = written(firsts, "warc-firsts").withColumnRenamed("digest", "known")
    both = rows.join(firsts, F.col("digest") == F.col("known"), "left")
    other = (F.col("first") != F.col("page_id")) | (F.col("first").isNotNull() & F.col("page_id").isNull())
    return both.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


CAPTURES = "key string, id long, file string, offset long, length long"
_CAPTURES = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_archives(roles: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of with_roles() to archives in folder; the captures: key, id (page_id, NO_ID without),
    file, offset, length. Only archives of tasks that ended well are named in them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, name, at, part = None, "", 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{folder}/archive-{task.partitionId():06d}-{part:03d}-{task.taskAttemptId()}.warc.gz"
                    out, at, part = shared_open(name, "wb"), 0, part + 1
                member = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                out.write(member)
                rows.append((r["key"], r["page_id"] if r["page_id"] is not None else NO_ID, name, at, len(member)))
                at += len(member)
            yield _arrow(rows, _CAPTURES)
        if out is not None:
            out.close()

    return roles.select("*", url_key(F.col("url")).alias("key")).mapInArrow(write, CAPTURES)


SHARDS = "key string, id long, directory string, last_key string, last_id long"
_SHARDS = pa.schema([("key", pa.string()), ("id", pa.int64()), ("directory", pa.string()), ("last_key", pa.string()), ("last_id", pa.int64())])


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sort captures (a written table) by key and id, and write shards of compressed blocks, each with its directory. One row
    for each shard: its first and last capture and the file of its directory; a shard is a task, so shards are as few as
    shuffle partitions."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/index-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        blocks, held, out, at, directory, last = 0, [], None, 0, [], None

        def flush() -> None:
            nonlocal at, out
            if out is None:
                out = shared_open(f"{name}.blocks", "wb")
            packed = gzip.compress("\n".join(json.dumps(r) for r in held).encode(), 6, mtime=0)
            out.write(packed)
            directory.append((*held[0][:2], at, len(packed)))
            at += len(packed)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                last = row
                if len(held) >= block:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with shared_open(f"{name}.directory", "wb") as f:
                f.write(gzip.compress(json.dumps({"blocks": f"{name}.blocks", "first": directory}).encode(), 6, mtime=0))
            yield _arrow([(*directory[0][:2], f"{name}.directory", *last[:2])], _SHARDS)

    return captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset").mapInArrow(write, SHARDS)


class Index:
    """Lookups of sorted or unsorted keys; holds one directory and one block of it at a time. shards: rows of write_index."""

    def __init__(self, shards: list[tuple]) -> None:
        # keys are compared as Spark sorts them, by their bytes
        self.shards = sorted((k.encode(), i, d, lk.encode(), li) for k, i, d, lk, li in shards)
        self.tops = [(k, i) for k, i, *_ in self.shards]
        self.directory, self.first, self.block_at, self.rows, self.keys, self.blocks = None, [], None, [], [], None

    def _open(self, directory: str) -> None:
        if self.directory != directory:
            with shared_open(directory, "rb") as f:
                held = json.loads(gzip.decompress(f.read()))
            if self.blocks is not None:
                self.blocks.close()
            self.blocks, self.places = shared_open(held["blocks"], "rb"), [(at, n) for _, _, at, n in held["first"]]
            self.first = [(k.encode(), i) for k, i, _, _ in held["first"]]
            self.directory, self.block_at = directory, None

    def _block(self, b: int) -> None:
        if self.block_at != b:
            at, n = self.places[b]
            self.blocks.seek(at)
            self.rows = [json.loads(x) for x in gzip.decompress(self.blocks.read(n)).split(b"\n")]
            self.keys = [(r[0].encode(), r[1]) for r in self.rows]
            self.block_at = b

    def find(self, key: str, page_id: int) -> list[tuple[str, int, int]]:
        """file, offset and length of every capture of a page under a key, in order."""
        want, out = (key.encode(), page_id), []
        s = max(0, bisect.bisect_left(self.tops, want) - 1)
        while s < len(self.shards) and self.tops[s] <= want:
            if self.shards[s][3:5] >= want:
                self._open(self.shards[s][2])
                b = max(0, bisect.bisect_left(self.first, want) - 1)
                while b < len(self.first) and self.first[b] <= want:
                    self._block(b)
                    i = bisect.bisect_left(self.keys, want)
                    while i < len(self.keys) and self.keys[i] == want:
                        out.append(tuple(self.rows[i][2:]))
                        i += 1
                    b += 1
            s += 1
        return out


FOUND = "file string, offset long, length long"
_FOUND = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def lookup(wanted: DataFrame, shards: list[tuple]) -> DataFrame:
    """The captures of pages (page_id, url): one row for each row of wanted; of repeated rows the n-th finds the n-th capture.
    A page that the index does not have is an error."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, before, found, nth = Index(shards), None, [], 0
        for batch in batches:
            rows = []
            for want in zip(batch["key"].to_pylist(), batch["id"].to_pylist(), strict=True):
                if want != before:
                    before, found, nth = want, index.find(*want), 0
                if not found:
                    raise LookupError(f"the index has no capture of page {want[1]} under {want[0]}")
                rows.append(found[nth % len(found)])
                nth += 1
            yield _arrow(rows, _FOUND)

    keyed = wanted.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"))
    return keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(find, FOUND)


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(found: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at places (a written table of file, offset, length), read by range in the order of the archives; payloads:
    whether to return them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, shared_open(file, "rb")
                f.seek(offset)
                r = parsed(f.read(length))
                rows.append(tuple(r[c] if payloads or c != "payload" else None for c in _READ.names))
            yield _arrow(rows, _READ)
        if f is not None:
            f.close()

    return found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, READ)


def archived(pages: DataFrame, folder: str | None = None, payloads: bool = True, min_revisit: int = MIN_REVISIT, block: int = BLOCK) -> DataFrame:
    """Archive every row of pages, index the archives, look every page up and read its record back: page_id, url,
    record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits, or where payloads is false).

    pages has page_id, url and html; other columns aren't read. Null html is an empty payload, a null URL has the empty
    key and no target in its record. Of records with equal payloads of at least min_revisit bytes that with the smallest
    page_id is the response; rows that repeat it, its page_id included, are responses too; rows without page_id revisit
    it. Empty table: no rows, and no archive. folder: where archives and index stay, else a folder of the shared one."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or shared_path(spark, "warc"))
    captures = written(write_archives(with_roles(pages, min_revisit), folder), "warc-captures")
    # one row for each shuffle partition at most
    shards = [tuple(r) for r in write_index(captures, folder, block).collect()]
    found = written(lookup(pages.select("page_id", "url"), shards), "warc-found")
    return read_records(found, payloads)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f"""
