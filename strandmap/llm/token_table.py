"""Token ids as sorted-string-table shards.

Documents are range-partitioned and sorted by doc_id and their text's hash, which splits many rows of
one doc_id or of none; each task tokenises its run and streams it into one shard file. There are as many
shards as shuffle partitions, and more where a shard would have over SHARD_BYTES of text or SHARD_DOCS
documents. A shard is::

    magic
    blocks    entries by key: shared prefix length, suffix length, suffix, number of ids, ids before
              it in the shard (varints), ids (2 or 4 bytes each, little-endian); then the block's crc32
    index     for each block: first key, offset, size
    Bloom     bits over all keys
    footer    offsets, sizes and counts of the above, width of an id, magic

A key is the doc_id as 8 big-endian bytes with the sign bit turned, so that byte order is number
order; a null doc_id is the empty key and comes first. ``lookup`` asks the Bloom filter, finds the
block by binary search in the sparse index and reads that block alone.

Files get a name of their own for each attempt, and a manifest written by Spark says which count,
so a lost executor or a repeated task does no harm. Null texts hold the end id alone. Rows that
share a doc_id are all kept, next to each other, in the order of their text's hash. Empty tables give
no shards. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import BATCH_BYTES, materialize, new_path, slices, tune

MAGIC = b"STRNDTK1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK, BITS_PER_KEY, HASHES = 64 << 10, 10, 7
END = 2
#: What a shard holds at most, but for one document, whatever the size of the table.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20

def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & (1 << 64) - 1, h >> 64 | 1


def places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bits of keys with these pairs of hashes: a row a key."""
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Streams entries in key order into a file; holds one block, the index and the keys' hashes."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.docs = self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must not fall")
        if self.width == 2 and len(ids) and ids.max() >> 16:
            raise ValueError("an id does not fit in two bytes")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(ids)) + varint(self.ids) + ids.astype(f"<u{self.width}").tobytes()
        if not self.docs or key != self.last:
            self.hashes.extend(hashes(key))
        self.last = key
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.index.append((self.first, self.at, len(data) + 4))
            self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(varint(len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index))
        own = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        bloom_at, bits = self.at, max(64, BITS_PER_KEY * len(own))
        bloom = np.zeros(-(-bits // 8) * 8, bool)
        for at in range(0, len(own), 4096):
            bloom[places(own[at : at + 4096, 0], own[at : at + 4096, 1], bits).ravel()] = True
        self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at, bits, len(self.index), self.docs, self.ids, self.width, MAGIC))


class Reader:
    """Reads footer, index and Bloom filter; then blocks as they are asked for."""

    def __init__(self, path: str):
        fs, p = filesystem(path)
        self.f = fs.open_input_file(p)
        size = self.f.size()
        index_at, bloom_at, self.bits, blocks, self.docs, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token table")
        raw, at = self._read(index_at, bloom_at - index_at), 0
        self.index: list[tuple[bytes, int, int]] = []
        for _ in range(blocks):
            n, at = read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self.firsts = [k for k, _, _ in self.index]
        self.bloom = self._read(bloom_at, size - FOOTER.size - bloom_at)

    def _read(self, at: int, n: int) -> bytes:
        return self.f.read_at(n, at)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of a block's entries."""
        _, at, size = self.index[i]
        data = self._read(at, size)
        data, crc = data[:-4], struct.unpack("<I", data[-4:])[0]
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        pos, key = 0, b""
        while pos < len(data):
            shared, pos = read_varint(data, pos)
            n, pos = read_varint(data, pos)
            key = key[:shared] + data[pos : pos + n]
            count, pos = read_varint(data, pos + n)
            start, pos = read_varint(data, pos)
            yield key, start, np.frombuffer(data, f"<u{self.width}", count, pos)
            pos += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all entries with this key."""
        key = key_of(doc_id)
        a, b = (np.array([x], np.uint64) for x in hashes(key))
        if not self.index or any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in places(a, b, self.bits)[0].tolist()):
            return []
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i and self.index[i][0] == key:  # equal keys may begin in the block before
            i -= 1
        out = []
        for j in range(i, len(self.index)):
            if self.index[j][0] > key:
                break
            out += [ids for k, _, ids in self.block(j) if k == key]
        return out


def _write(folder: str, path: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w = encoder(path), None
        shard = TaskContext.get().partitionId()
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.tok"
        for b in slices(batches, limit=BATCH_BYTES):
            if w is None:
                fs, p = filesystem(file)
                fs.create_dir(p.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(p)
                w = Writer(out, 2 if max(enc.vocabulary, end + 1) <= 1 << 16 else 4)
            ids, bounds = enc.flat(pc.fill_null(b.column(1), ""), end)
            bounds = bounds.tolist()
            for doc, at, to in zip(b.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                w.add(key_of(doc), ids[at:to])
        if w:
            w.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "docs": [w.docs], "ids": [w.ids]})

    return run


def write(docs: DataFrame, path: str | None = None, end: int = END, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """The manifest of the shards written: shard, file, docs, ids. path: the tokenizer's file. Shards that are
    to last need a folder of their own, which all executors share; else they go at the end of the process."""
    spark = docs.sparkSession
    tune(spark)
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[0] or 0) // SHARD_BYTES), -(-size[1] // SHARD_DOCS))
    order = ("doc_id", F.xxhash64("text"))
    runs = docs.select("doc_id", "text").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    how = _write(folder or new_path(spark, "token-table"), path or tokenizer_path("byte_bpe_50k.json"), end)
    return materialize(runs.mapInArrow(how, "shard int, file string, docs bigint, ids bigint"), "manifest")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for key, start, ids in Reader(file):
                rows.append((doc_of(key), base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the shards.

    The driver sees one row a shard, to number the ids across shards; shards are SHARD_BYTES of text each
    where there are more of them than shuffle partitions."""
    spark = manifest.sparkSession
    rows, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((r.file, base))
        base += r.ids
    files = spark.createDataFrame(rows, "file string, base bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
