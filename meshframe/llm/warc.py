"""WARC archives from a deterministic sharded writer: records in key order, files rolled by compressed size."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, hot_rows, join_one, stash
from .files import committed, open_fs
from .ranges import range_shards, shard_bytes

#: Payloads shorter than this are never revisits (query contract).
LEAST_PAYLOAD = 100
#: A file is closed and the next begun after this share of a shard's bytes, compressed.
ROLL_SHARE = 8
#: Bytes read at once; what is left of them after a member is copied, so they are few.
READ_BYTES = 1 << 14
#: Fixed values of WARC/1.1 and its profile for revisits.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry one date, so that reruns give equal bytes.
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: int | None, digest: bytes) -> str:
    h = hashlib.sha256(f"{page_id}|".encode() + digest).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: the payload under an HTTP header, or for a revisit the HTTP header alone; digests regenerated."""
    digest = hashlib.sha256(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Payload-Digest", "sha256:" + base64.b32encode(digest).decode()),
        ("WARC-Block-Digest", "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode()),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    """One gzip member; no time or name in its header."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", roll: int | None = None, target: int | None = None) -> DataFrame:
    """Writes one record a row; the manifest (shard, file, records, bytes, sha256), written beside the archives.

    Of rows with equal payloads of LEAST_PAYLOAD bytes or more the least key is the response and the others revisit it
    (rows that repeat key and payload: the first of them). Only keys and digests meet to find that out; the pages travel
    once, together with the revisits, by ranges of the key. A shard is written in key order and rolled by compressed
    size (``roll``; an eighth of a shard's raw bytes unless given). Long pages are records of their own in memory, one at a
    time beside the batch they came in. Null html is an empty payload; null keys come first and are responses only if no other key has the payload.
    Further columns are ignored; an empty table gives a manifest without files.
    """
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    pages = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    size = F.octet_length("html")
    long_ones = stash(pages.where(size >= LEAST_PAYLOAD).select("key", F.unhex(F.sha2("html", 256)).alias("digest")), "warc-digests")
    groups = long_ones.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_one(long_ones, groups, ["digest"], "n", hot_rows(long_ones.count())).where(~F.col("key").eqNullSafe(F.col("first")))
    later = later.groupBy("key", "digest").agg(F.min("first").alias("first"))
    rows = pages.select("key", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("first"))
    weight = F.octet_length("html") + 256
    target = target or shard_bytes(rows.agg(F.sum(weight)).first()[0] or 0)
    roll = roll or target // ROLL_SHARE
    shard, n = range_shards(rows, "key", weight, target)
    marks = later.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    both = rows.unionByName(marks).withColumn("__shard", shard)
    dealt = both.repartitionById(n, F.col("__shard")).sortWithinPartitions("__shard", F.col("key").asc_nulls_first(), "kind", "url", "html")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        manifest: list[tuple] = []
        held = out = None
        shard_at = part = 0
        name, records, written, sha = "", 0, 0, None

        def close() -> None:
            nonlocal held
            if held is not None:
                held.__exit__(None, None, None)
                manifest.append((shard_at, name, records, written, sha.hexdigest()))
                held = None

        current, marks_here, seen = object(), {}, set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != current:
                    current, marks_here, seen = row["key"], {}, set()
                if row["kind"] == 0:
                    marks_here[row["digest"]] = row["first"]
                    continue
                if held is not None and row["__shard"] != shard_at:
                    close()
                    part = 0
                elif held is not None and written >= roll:
                    close()
                    part += 1
                if held is None:
                    shard_at = row["__shard"]
                    name, records, written, sha = f"pages-{shard_at:06d}-{part:04d}.warc.gz", 0, 0, hashlib.sha256()
                    held = committed(folder, name)
                    out = held.__enter__()
                    info = f"software: meshframe\r\nformat: {VERSION}\r\n".encode()
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name.encode())), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
                    data = _gzip(_header(head) + info + b"\r\n\r\n")
                    out.write(data)
                    sha.update(data)
                    written += len(data)
                payload = row["html"].encode()
                digest = hashlib.sha256(payload).digest()
                again = len(payload) >= LEAST_PAYLOAD and digest in seen and digest not in marks_here
                revisit = digest in marks_here or again
                seen.add(digest)
                data = _gzip(record(row["key"], row["url"], payload, marks_here.get(digest, row["key"]) if revisit else None, revisit))
                out.write(data)
                sha.update(data)
                written += len(data)
                records += 1
        close()
        columns = list(zip(*manifest, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    schema = "shard int, file string, records long, bytes long, sha256 string"
    dealt.mapInArrow(write, schema).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(schema).parquet(f"{folder}/_manifest")


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, member by member; one record is in memory at a time."""
    z, data, tail = zlib.decompressobj(31), bytearray(), b""
    while True:
        chunk = tail or source.read(READ_BYTES)
        if not chunk:
            break
        data += z.decompress(chunk)
        tail = z.unused_data
        if z.eof:
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            z, data = zlib.decompressobj(31), bytearray()
    if data:
        raise ValueError("the archive ends inside a record")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the records, their digests verified."""
    n = max(1, manifest.count())
    listed = manifest.select("file", F.pmod(F.xxhash64("file"), F.lit(n)).cast("int").alias("part"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = open_fs(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as source:
                    for headers, block in read_records(source):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha256:"))
                        if hashlib.sha256(block).digest() != base64.b32decode(headers["WARC-Block-Digest"].removeprefix("sha256:")):
                            raise ValueError(f"{file}: a block differs from its digest")
                        if headers["WARC-Type"] == "response" and hashlib.sha256(block.partition(b"\r\n\r\n")[2]).digest() != digest:
                            raise ValueError(f"{file}: a payload differs from its digest")
                        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page", "")
                        rows.append((int(page) if page else None, int(headers["X-Payload-Length"]), digest.hex(), headers["WARC-Type"], int(refers) if refers else None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return listed.repartitionById(n, F.col("part")).select("file").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(manifest, folder)


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
