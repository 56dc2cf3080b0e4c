"""Sorted-string-table shards of token ids.

A shard is one file: data blocks, a sparse index, a Bloom filter and a footer. Integers are little-endian.

* entry: u16 shared key bytes, u16 further key bytes, u32 number of ids, further key bytes, ids (u16 each if the shard's flag is 0, else u32)
* block: u32 number of entries, entries; the first entry of a block shares nothing; a block ends once it holds ``block_bytes``
* index: for each block u32 key length, key of its first entry, u64 position, u32 length
* Bloom filter: u32 probes, u32 bytes, the bits; each of the probes is h1 + k * h2 over XXH64 halves
* footer of 64 bytes: u64 index position, u64 index length, u64 filter position, u64 filter length, u64 documents, u64 ids, u32 id width flag, u32 crc32 of the index, 8 bytes magic

Keys are the doc_id as nine bytes whose order is that of the ids: 0 and eight zero bytes for null, else 1 and the id plus 2^63, big-endian.
Documents are range-partitioned by doc_id and text hash, about ``shard_bytes`` of text to a task, so the shards in order of their names hold all keys in ascending order;
a task begins another file beyond ``MAX_FILE`` bytes, so no file but that of one huge document nears the 2 GB that a reader takes whole.
A shard is written under another name and then renamed, so a task that runs twice leaves whole files.

Defined cases: a null or empty text is the end id alone; repeated doc_ids stay next to each other (ordered by text hash and text), in one shard or in
neighbouring ones, and a look-up in each of these returns all of them; an empty table writes no shard; other columns are ignored; a text of any length is one entry in one block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import encoding
from sextant.llm.common import qualified, work_path

MAGIC, PROBES, BITS_PER_KEY = b"SXTSST01", 7, 10
#: Text for one task, and size of a file beyond which the task begins another.
SHARD_BYTES, MAX_FILE = 16 << 20, 256 << 20
_FOOTER = struct.Struct("<6Q2I8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key, 0)
    return [((h & 0xFFFFFFFF) + k * (h >> 32 | 1)) % bits for k in range(PROBES)]


class ShardWriter:
    """Writes entries in ascending key order to an open binary file; holds one block, the index and 64 bits a key."""

    def __init__(self, out, wide: bool, block_bytes: int = 64 << 10):
        self.out, self.wide, self.block_bytes = out, wide, block_bytes
        self.at, self.docs, self.ids = 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.size, self.entries, self.first, self.last = [], 4, 0, b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.entries:
            while shared < len(key) and self.last[shared : shared + 1] == key[shared : shared + 1]:
                shared += 1
        else:
            self.first = key
        data = struct.pack("<HHI", shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.block.append(data)
        self.size += len(data)
        self.entries += 1
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.entries:
            self.index.append((self.first, self.at, self.size))
            self._write(struct.pack("<I", self.entries) + b"".join(self.block))
        self._begin()

    def finish(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        index_at = self.at
        self._write(index)
        bits = -(-max(64, BITS_PER_KEY * len(self.keys)) // 8) * 8
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._write(struct.pack("<II", PROBES, len(bloom)) + bloom)
        self._write(_FOOTER.pack(index_at, len(index), bloom_at, len(bloom) + 8, self.docs, self.ids, int(self.wide), zlib.crc32(index), MAGIC))


class Shard:
    """A shard's bytes, for scans in key order and binary-search look-ups."""

    def __init__(self, data: bytes):
        self.data = data
        index_at, index_len, bloom_at, bloom_len, self.docs, self.ids, wide, crc, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        index = data[index_at : index_at + index_len]
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole shard")
        self.kind, self.bloom = np.dtype("<u4" if wide else "<u2"), data[bloom_at + 8 : bloom_at + bloom_len]
        self.firsts, self.blocks, at = [], [], 0
        while at < len(index):
            n = struct.unpack_from("<I", index, at)[0]
            self.firsts.append(index[at + 4 : at + 4 + n])
            self.blocks.append(struct.unpack_from("<QI", index, at + 4 + n))
            at += 16 + n

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, key = self.blocks[block][0], b""
        count = struct.unpack_from("<I", self.data, at)[0]
        at += 4
        for _ in range(count):
            shared, more, n = struct.unpack_from("<HHI", self.data, at)
            at += 8
            key = key[:shared] + self.data[at : at + more]
            at += more
            yield key, np.frombuffer(self.data, self.kind, n, at)
            at += n * self.kind.itemsize

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def may_contain(self, key: bytes) -> bool:
        bits = 8 * len(self.bloom)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this key; none if it is absent."""
        key = key_of(doc_id)
        if not self.may_contain(key):
            return []
        block, out = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while block < len(self.blocks) and self.firsts[block] <= key:
            out += [ids for k, ids in self._entries(block) if k == key]
            block += 1
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """Encode documents and write them to ``path``; returns the manifest (shard, file, docs, ids), one row per file."""
    path = qualified(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.count("*"))).first()[0]
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-size // shard_bytes)), *order)
    rows = rows.sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, task = encoding.encoder(tokenizer), TaskContext.get()
        where, folder = fs.FileSystem.from_uri(path)
        writer = out = None
        done: list[tuple] = []

        def close() -> None:
            name = f"{task.partitionId():08d}-{len(done):04d}.sst"
            writer.finish()
            out.close()
            where.move(temp, f"{folder}/{name}")
            done.append((task.partitionId(), name, writer.docs, writer.ids))

        for part in parts:
            for first, texts in encoding.batches(part.column(1)):
                for k, ids in enumerate(enc.encode(texts)):
                    if writer is not None and writer.at > MAX_FILE:
                        close()
                        writer = None
                    if writer is None:
                        temp = f"{folder}/.{task.partitionId():08d}-{len(done):04d}-{task.taskAttemptId()}"
                        where.create_dir(folder)
                        out = where.open_output_stream(temp)
                        writer = ShardWriter(out, wide)
                    writer.add(key_of(part.column(0)[first + k].as_py()), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            close()
        if done:
            shard, file, n, total = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "file": list(file), "docs": list(n), "ids": list(total)})

    return rows.mapInArrow(run, "shard int, file string, docs long, ids long")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, position, start, n_tokens, ids_crc32) of every document, by scanning the files in key order; ``start`` counts from the shard's begin."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, content in zip(part.column(0), part.column(1), strict=True):
                rows, start = [], 0
                for n, (doc_id, ids) in enumerate(Shard(content.as_py()).scan()):
                    rows.append((doc_id, n, start, len(ids), encoding.crc32(ids)))
                    start += len(ids)
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows)), *cols], ["file", "doc_id", "position", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "file string, doc_id long, position long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write documents as shards in the shared folder, read the files back and say where each document lies in them.

    Only the manifest, a row for each ``shard_bytes`` of text, comes to the driver: it gives each shard its first position.
    """
    spark = docs.sparkSession
    path = work_path(spark, "sst")
    manifest = sorted(write_shards(docs, path, tokenizer, end_id, shard_bytes).collect(), key=lambda r: r["file"])
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    firsts, total = [], 0
    for row in manifest:
        firsts.append((row["file"], total))
        total += row["ids"]
    firsts = spark.createDataFrame(firsts, "file string, first long")
    got = read_shards(spark, path).join(firsts, "file")
    return got.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
