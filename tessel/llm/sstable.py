"""Token ids in sorted-string-table shards.

A shard holds the documents of one key range in ascending key order:

    magic | block ... | block index | Bloom filter | footer | magic

Keys are the identifiers as eight big-endian bytes with the sign bit flipped (null: the empty key, first).
Inside a block a key is stored as the length of the prefix it shares with the one before it and the rest;
the first key of a block is whole. Values are ids as little-endian 16-bit integers, or 32-bit where one
needs it. Blocks are compressed. The sparse index has each block's first key and place, so a look-up asks
the Bloom filter, bisects the index and scans one block.

Writing: the table is range-partitioned and sorted by identifier once; each task encodes its texts and writes them as shards of about
SHARD_BYTES, each under a temporary name that is then changed, so a task that runs again after the loss of an executor
leaves the same files; what a lost attempt left is removed at the end. A shard's keys are held until it is closed, for its Bloom filter.
The manifest has one row per shard. Reading back is one task per few shards, block by block.

Defined cases: null text is empty (only the end id is stored); a null identifier is a key of its own and comes first;
repeated identifiers are kept as separate entries, ordered by text; bytes that are no UTF-8 are read as U+FFFD; an empty table gives no shard;
other columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, texts, utf8
from .token_counts import GROUP_BYTES, loaded

MAGIC = b"tsslsst1"
BLOCK_BYTES = 256 << 10
#: Compressed bytes and documents from which a shard is closed.
SHARD_BYTES, SHARD_DOCS = 128 << 20, 1 << 20
BLOOM_BITS_A_KEY = 10
BLOOM_HASHES = 7


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Bits of a Bloom filter: a row for each key."""
    one = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    two = np.array([xxhash.xxh3_64_intdigest(k, 1) | 1 for k in keys], np.uint64)
    return ((one[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes = out, block_bytes
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.block, self.last, self.first, self.n = bytearray(), b"", None, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.docs = self.ids = 0
        self.codec = zstandard.ZstdCompressor(level=1)
        self.least = self.most = None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.most is not None and key < self.most:
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids) << 1 | wide) + value
        self.last, self.n = key, self.n + 1
        self.least = key if self.least is None else self.least
        self.most = key
        self.hashes.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            packed = self.codec.compress(bytes(self.block))
            self.out.write(packed)
            self.index.append((self.first, self.at, len(packed), self.n))
            self.at += len(packed)
            self.block, self.first, self.n = bytearray(), None, 0

    def close(self) -> dict:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) + _varint(n) for k, at, size, n in self.index)
        bits = max(64, -(-self.docs * BLOOM_BITS_A_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for at in range(0, len(self.hashes), 1 << 16):
            bloom[_places(self.hashes[at : at + (1 << 16)], bits)] = True
        bloom = np.packbits(bloom, bitorder="little")
        footer = json.dumps({"docs": self.docs, "ids": self.ids, "index": [self.at, len(index)], "bloom": [self.at + len(index), len(bloom)], "blocks": len(self.index)}).encode()
        self.out.write(index + bloom.tobytes() + footer + struct.pack("<I", len(footer)) + MAGIC)
        return {"docs": self.docs, "ids": self.ids, "first": self.least, "last": self.most}


class Shard:
    """Reads one shard: get() by binary search, entries() in order."""

    def __init__(self, file):
        self.file = file
        size = file.size() if hasattr(file, "size") else file.seek(0, io.SEEK_END)
        tail = self._bytes(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a shard")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._bytes(size - 12 - length, length))
        data, at, self.index = self._bytes(*self.footer["index"]), 0, []
        for _ in range(self.footer["blocks"]):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            entries, at = _read_varint(data, at)
            self.index.append((key, place, length, entries))
        self.bloom = self._bytes(*self.footer["bloom"])
        self.codec = zstandard.ZstdDecompressor()

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places([key], 8 * len(self.bloom))[0].tolist())

    def block(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length, entries = self.index[number]
        data, at, key = self.codec.decompress(self._bytes(place, length)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            n, at = _read_varint(data, at)
            wide, n = n & 1, n >> 1
            yield key, np.frombuffer(data, "<u4" if wide else "<u2", n, at).astype("<u4")
            at += n * (4 if wide else 2)

    def entries(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier."""
        key = key_of(identifier)
        if not self.index or not self.may_have(key):
            return []
        firsts = [x[0] for x in self.index]
        number = max(0, bisect_right(firsts, key) - 1)
        while number > 0 and firsts[number] == key:  # equal keys may begin in the block before
            number -= 1
        out = []
        while number < len(self.index) and firsts[number] <= key:
            out += [ids for k, ids in self.block(number) if k == key]
            number += 1
        return out


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def open_shard(path: str) -> Shard:
    files, place = _files(path)
    return Shard(files.open_input_file(place))


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> list[dict]:
    """Encode every whole text, append end_id, write the shards below `path`, and give the manifest: one small row per shard, in key order."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, folder = _files(path)
    files.create_dir(folder, recursive=True)

    def run(batches):
        tokenizer = loaded(tokenizer_path)
        files, folder = _files(path)
        task, number, writer = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("name", pa.string()), ("first_key", pa.binary()), ("docs", pa.int64()), ("ids", pa.int64())])

        def closed() -> pa.RecordBatch:
            made = writer.close()
            out.close()
            files.move(temporary, f"{folder}/{name}")
            return pa.RecordBatch.from_pylist([{"name": name, "first_key": made["first"], "docs": made["docs"], "ids": made["ids"]}], schema)

        for batch in batches:
            for part in slices(batch, "text", GROUP_BYTES):
                ids, ends = tokenizer.words(utf8(part.column("text"))).text_ids()
                starts = np.r_[0, ends[:-1]]
                for key, start, end in zip(part.column("doc_id").to_pylist(), starts.tolist(), ends.tolist()):
                    if writer is None:
                        name = f"{task:06d}-{number:06d}.sst"
                        temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
                        writer = ShardWriter(out := files.open_output_stream(temporary))
                    writer.add(key_of(key), np.append(ids[start:end], np.uint32(end_id)))
                    if writer.at >= shard_bytes or writer.docs >= shard_docs:
                        yield closed()
                        writer, number = None, number + 1
        if writer is not None:
            yield closed()

    ordered = rows.repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = ordered.mapInArrow(run, "name string, first_key binary, docs bigint, ids bigint").collect()
    for left in files.get_file_info(pafs.FileSelector(folder)):
        if left.base_name.startswith("."):
            files.delete_file(left.path)
    manifest, start = [], 0
    for row in sorted(made, key=lambda r: r["name"]):
        manifest.append({"path": f"{path}/{row['name']}", "start": start, "docs": row["docs"], "ids": row["ids"]})
        start += row["ids"]
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids of all entries before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = open_shard(path)
                for number in range(len(shard.index)):
                    keys, starts, counts, sums = [], [], [], []
                    for key, ids in shard.block(number):
                        keys.append(identifier_of(key))
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")
    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """write_shards() into the shared folder, then read_shards()."""
    return read_shards(docs.sparkSession, write_shards(docs, new_path(docs.sparkSession, "sst"), tokenizer_path, end_id))
