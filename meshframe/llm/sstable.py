"""Token-id shards as sorted string tables: prefix-compressed blocks, sparse index, Bloom filter, footer."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, stash
from .files import committed, open_fs
from .ranges import range_shards
from .tokens import encoder, tokenizer_path

#: Fixed values of the file format.
MAGIC = b"MFSST02\n"
FOOTER = struct.Struct("<QQQQQQQII8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_bytes(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do: null first, then by value."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one table to a stream; keys come in ascending order, equal keys stay in the order given."""

    def __init__(self, out):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=3)
        self.at = self.records = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last, self.lowest = bytearray(), b"", b"", b""
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.records and key < self.last:
            raise ValueError("keys must ascend")
        if not self.records:
            self.lowest = key
        if not self.block:
            self.first = self.last = key
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value) << 1 | wide) + value
        if not self.keys or key != self.keys[-1]:
            self.keys.append(key)
        self.last = key
        self.records += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data), zlib.crc32(data)))
            self._put(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + struct.pack("<I", crc) for k, at, n, crc in self.index)
        self._put(index)
        bloom_at = self.at
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        crc = zlib.crc32(bytes(bloom), zlib.crc32(index))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom), self.records, self.ids, len(self.index), bits, crc, MAGIC))


class Reader:
    """Looks keys up, or reads all, in one table; holds the index, the filter and one block."""

    def __init__(self, source):
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        size = source.size()
        index_at, index_n, bloom_at, bloom_n, self.records, self.ids, blocks, self.bits, crc, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        self.bloom = self._at(bloom_at, bloom_n)
        data, at = self._at(index_at, index_n), 0
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC or zlib.crc32(self.bloom, zlib.crc32(data)) != crc:
            raise ValueError("not a whole table")
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int, int]] = []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            start, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.places.append((start, length, struct.unpack_from("<I", data, at)[0]))
            at += 4

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        start, length, crc = self.places[i]
        packed = self._at(start, length)
        if zlib.crc32(packed) != crc:
            raise ValueError("a block differs from its checksum")
        data, at, key = self.zip.decompress(packed), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            size, at = _read_varint(data, at + n)
            yield key, np.frombuffer(data, "<u4" if size & 1 else "<u2", count=(size >> 1) // (4 if size & 1 else 2), offset=at).astype(np.uint32)
            at += size >> 1

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of all records with this key, by filter, binary search of the index, and one block or its followers."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i and self.firsts[i] == key:
            i -= 1
        found = []
        for j in range(i, len(self.places)):
            if self.firsts[j] > key:
                break
            found += [ids for k, ids in self._block(j) if k == key]
        return found


def write_tables(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, target: int | None = None) -> DataFrame:
    """Encodes texts into one table a range shard; the manifest, written beside them: (shard, file, records, ids, first_key, last_key).

    ``df`` is range-partitioned by exact sums of its bytes and sorted in each shard by key, then text, so the files do
    not depend on how the input lay. Further columns are ignored, an empty table gives a manifest without files. Null keys come first, repeated keys follow each other, null texts are empty. A task
    holds one slice of texts and one block. Files get their names when whole; the manifest, written last, is the commit.
    """
    bounded_batches(df.sparkSession)
    spark, path = df.sparkSession, path or tokenizer_path()
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    shard_of, n = range_shards(rows, "key", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, target)
    dealt = rows.withColumn("__shard", shard_of).repartitionById(n, F.col("__shard")).sortWithinPartitions("__shard", F.col("key").asc_nulls_first(), "text")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, writer, at, manifest, held = encoder(path).encode, None, None, [], None
        for batch in batches:
            shards, keys = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for shard, k, ids in zip(shards, keys, encode(batch.column(1).to_pylist()), strict=True):
                if shard != at:
                    if writer is not None:
                        writer.close()
                        held.__exit__(None, None, None)
                        manifest.append((at, f"shard-{at:06d}.sst", writer.records, writer.ids, key_value(writer.lowest), key_value(writer.last)))
                    held = committed(folder, f"shard-{shard:06d}.sst")
                    writer, at = Writer(held.__enter__()), shard
                writer.add(key_bytes(k), ids)
        if writer is not None:
            writer.close()
            held.__exit__(None, None, None)
            manifest.append((at, f"shard-{at:06d}.sst", writer.records, writer.ids, key_value(writer.lowest), key_value(writer.last)))
        columns = list(zip(*manifest, strict=True)) or [()] * 6
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "file", "records", "ids", "first_key", "last_key"])

    schema = "shard int, file string, records long, ids long, first_key long, last_key long"
    dealt.mapInArrow(write, schema).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(schema).parquet(f"{folder}/_manifest")


def lookup(manifest: DataFrame, folder: str, key: int | None) -> list[np.ndarray]:
    """The ids of all records with this key: the manifest's key ranges name the file, its filter and index the block."""
    within = F.lit(key is None) & F.col("first_key").isNull() if key is None else (F.coalesce(F.col("first_key") <= key, F.lit(True)) & (F.col("last_key") >= key))
    fs, base = open_fs(folder)
    found: list[np.ndarray] = []
    for r in manifest.where(within).select("file").orderBy("file").collect():
        with fs.open_input_file(f"{base}/{r['file']}") as source:
            found += Reader(source).get(key_bytes(key))
    return found


def read_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all records in the tables, one task for each few files.

    start counts the ids of all records before: those of earlier shards by the manifest's sums, the rest in the file.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("shard", "file", before.alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base_path = open_fs(folder)
        for batch in batches:
            for file, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{base_path}/{file}") as source:
                    for key, ids in Reader(source):
                        rows.append((key_value(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) >= 10_000:
                            yield _rows(pa, rows)
                            rows = []
                yield _rows(pa, rows)

    return listed.repartitionById(n, F.col("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(pa, rows: list[tuple]):
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "sstable")
    manifest = write_tables(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_tables(manifest, folder)
