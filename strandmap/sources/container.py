"""The binary container of variation graphs: a Python data source that reads one module of it
(``spark.read.format("graph_container").option("module", ...)``) and a writer.

A file is a sequence of little-endian 64-bit words without a table of contents. ``layout`` finds
where every part begins by seeking over the bodies, so a module that is not asked for is not
read. Long modules (records, sequences, segments) are cut into index ranges, one a task: a
task finds its range in the Elias-Fano start index and reads only its own bytes of the body.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codec
from ..functions.dna import BASES, FULL, PER_WORD
from ..operators.graph import cut

# Fixed values of the format: tags in the low half of a header's first word, flag bits, the mark of no value.
CONTAINER_TAG = 0x205A4247
INDEX_TAG = 0x6B376B37
METADATA_TAG = 0x6B375E7A
GRAPH_TAG = 0x6B3764AF
INDEX_BIDIRECTIONAL, INDEX_METADATA, INDEX_SIMPLE = 1, 2, 4
GRAPH_TRANSLATION, GRAPH_ZSTD = 1, 2
NO_VALUE = 0xFFFFFFFF

#: Entries of a module that one task reads, and words of a bit vector held at once.
ROWS_A_TASK, WORDS_A_BLOCK = 1 << 20, 1 << 17

MODULES = {
    "headers": "module string, version int, fields map<string, bigint>, flags bigint",
    "tags": "module string, key string, value string",
    "records": "record_id bigint, sigma int, data binary, outgoing array<struct<to:bigint,rank_offset:bigint>>, runs array<struct<outrank:bigint,len:bigint>>",
    "record_bytes": "record_id bigint, data binary",
    "sequences": "node_id bigint, seq string",
    "packed": "node_id bigint, bits int, words array<int>, length int",
    "paths": "path_id bigint, sample bigint, contig bigint, phase bigint, fragment bigint",
    "samples": "id bigint, name string",
    "contigs": "id bigint, name string",
    "segments": "segment_id bigint, name string, start_node bigint",
    "da_samples": "part string, idx bigint, value bigint",
}


# Reading. A part is found by its offset; its body is read in slices only.


class Words:
    """A seekable file of 64-bit words."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(name)
        self.size, self.at = self.file.size(), 0

    def bytes_at(self, at: int, n: int) -> bytes:
        if n < 0 or at + n > self.size:
            raise ValueError(f"a part of {n} bytes at {at} passes the end of the file")
        return self.file.read_at(n, at)

    def words_at(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.bytes_at(at, 8 * n), "<u8")

    def take(self, n: int = 1) -> list[int]:
        out = self.words_at(self.at, n).tolist()
        self.at += 8 * n
        return out

    def peek_tag(self) -> int | None:
        return int(self.words_at(self.at, 1)[0]) & NO_VALUE if self.at + 8 <= self.size else None

    def skip(self, n: int) -> int:
        """Step over n bytes, padded to words; where they begin."""
        begin = self.at
        if n < 0 or n > self.size - begin:
            raise ValueError(f"a part of {n} bytes at {begin} passes the end of the file")
        self.at += -(-n // 8) * 8
        return begin


def ints_part(f: Words) -> dict:
    n, width, bits, words = f.take(4)
    if n * width != bits or words != -(-bits // 64) or width > 64:
        raise ValueError("packed integers: sizes disagree")
    return {"n": n, "width": width, "at": f.skip(8 * words)}


def bits_part(f: Words) -> dict:
    ones, n, words = f.take(3)
    if words != -(-n // 64):
        raise ValueError("bit vector: sizes disagree")
    part = {"ones": ones, "n": n, "at": f.skip(8 * words)}
    for _ in range(3):  # optional indexes, rebuilt where needed
        f.skip(8 * f.take()[0])
    return part


def sparse_part(f: Words) -> dict:
    return {"universe": f.take()[0], "high": bits_part(f), "low": ints_part(f)}


def bytes_part(f: Words) -> dict:
    n = f.take()[0]
    return {"n": n, "at": f.skip(n)}


def strings_part(f: Words) -> dict:
    return {"index": sparse_part(f), "alphabet": bytes_part(f), "chars": ints_part(f)}


def int_slice(f: Words, part: dict, lo: int, hi: int) -> np.ndarray:
    """Values lo to hi of packed integers."""
    width, out = part["width"], np.zeros(max(hi - lo, 0), np.uint64)
    if not width:
        return out
    step = WORDS_A_BLOCK
    for a in range(lo, hi, step):
        b = min(a + step, hi)
        first = a * width // 64
        bits = np.unpackbits(f.words_at(part["at"] + 8 * first, -(-b * width // 64) - first).view(np.uint8), bitorder="little")
        own = bits[a * width - 64 * first :][: (b - a) * width].reshape(b - a, width)
        for k in range(width):
            out[a - lo : b - lo] |= own[:, k].astype(np.uint64) << np.uint64(k)
    return out


def set_positions(f: Words, part: dict, lo: int, hi: int) -> np.ndarray:
    """Places of the set bits number lo to hi (from 0)."""
    found, seen, words = [], 0, -(-part["n"] // 64)
    for a in range(0, words, WORDS_A_BLOCK):
        if seen >= hi:
            break
        block = f.words_at(part["at"] + 8 * a, min(WORDS_A_BLOCK, words - a))
        n = int(np.bitwise_count(block).sum())
        if seen + n > lo:
            places = np.flatnonzero(np.unpackbits(block.view(np.uint8), bitorder="little")) + 64 * a
            found.append(places[max(lo - seen, 0) : hi - seen])
        seen += n
    out = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(out) != max(hi - lo, 0):
        raise ValueError("bit vector: fewer set bits than entries")
    return out


def sparse_slice(f: Words, part: dict, lo: int, hi: int) -> np.ndarray:
    """Values lo to hi of an Elias-Fano coded sorted list."""
    high = set_positions(f, part["high"], lo, hi) - np.arange(lo, hi)
    return high << part["low"]["width"] | int_slice(f, part["low"], lo, hi).astype(np.int64)


def bounds(f: Words, index: dict, lo: int, hi: int, total: int) -> np.ndarray:
    """Starts of entries lo to hi and the end of the last."""
    n = index["low"]["n"]
    return sparse_slice(f, index, lo, hi + 1) if hi < n else np.append(sparse_slice(f, index, lo, hi), total)


def string_slice(f: Words, part: dict, lo: int, hi: int) -> list[str]:
    if hi <= lo:
        return []
    if "zstd" in part:  # one compressed block: every task has to open it
        ends = bounds(f, part["index"], lo, hi, part["n"])
        raw = pa.decompress(f.bytes_at(part["zstd"]["at"], part["zstd"]["n"]), part["n"], "zstd", asbytes=True)[ends[0] : ends[-1]]
    else:
        ends = bounds(f, part["index"], lo, hi, part["chars"]["n"])
        alphabet = np.frombuffer(f.bytes_at(part["alphabet"]["at"], part["alphabet"]["n"]), np.uint8)
        raw = alphabet[int_slice(f, part["chars"], int(ends[0]), int(ends[-1])).astype(np.int64)].tobytes() if ends[-1] > ends[0] else b""
    cuts = (ends - ends[0]).tolist()
    return [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def packed_slice(f: Words, part: dict, lo: int, hi: int) -> Iterator[tuple]:
    """(node, bits of a base, words, length) of labels lo to hi, recoded without a string of any. All labels of a file
    have 3 bits if its alphabet has an N, else 2."""
    alphabet = f.bytes_at(part["alphabet"]["at"], part["alphabet"]["n"]).decode("latin-1").upper()
    if not set(alphabet) <= set(BASES):
        raise ValueError(f"labels have other characters than {BASES}")
    bits = 3 if "N" in alphabet else 2
    per = PER_WORD[bits]
    ends = bounds(f, part["index"], lo, hi, part["chars"]["n"])
    length = np.diff(ends)
    code = np.array([BASES.index(c) for c in alphabet] or [0], np.int64)[int_slice(f, part["chars"], int(ends[0]), int(ends[-1])).astype(np.int64)]
    place = np.arange(len(code)) - np.repeat(ends[:-1] - ends[0], length)
    count = -(-length // per)
    first = np.cumsum(count) - count
    words = np.zeros(int(count.sum()), np.int64)
    np.bitwise_or.at(words, np.repeat(first, length) + place // per, code << place % per * bits)
    full = np.arange(len(words)) - np.repeat(first, count) < np.repeat(length // per, count)
    words = np.where(full, words - FULL, words).tolist()
    for i, (a, n, size) in enumerate(zip(first.tolist(), count.tolist(), length.tolist(), strict=True), lo + 1):
        yield i, bits, words[a : a + n], size


def header(f: Words, tag: int, names: tuple[str, ...]) -> dict:
    first, *rest = f.take(1 + len(names))
    if first & NO_VALUE != tag:
        raise ValueError(f"header tag {first & NO_VALUE:#x} where {tag:#x} belongs")
    return {"version": first >> 32, **dict(zip(names, rest, strict=True))}


def block(f: Words, flag: bool) -> int | None:
    """Size in bytes of an optional block that begins here; None where there is none: its first word is zero, or
    no size that the rest of the file could hold, and then it belongs to what follows (f stays before it)."""
    begin = f.at
    n = f.take()[0] if f.at + 8 <= f.size else 0
    if n and 8 * n > f.size - f.at or f.at > f.size:
        f.at = begin
        return None
    if not n and flag:
        raise ValueError("the index header and the metadata block disagree")
    return 8 * n or None


def layout(f: Words) -> dict:
    """Headers and the place of every part. Optional blocks may be empty or, in old files, left out."""
    out = {"container": header(f, CONTAINER_TAG, ("flags",)), "container_tags": strings_part(f)}
    out["index"] = header(f, INDEX_TAG, ("sequences", "size", "offset", "alphabet", "flags"))
    if not out["index"]["flags"] & INDEX_SIMPLE:
        raise ValueError("only the simple serialisation of the index is read")
    out["index_tags"], out["starts"], out["records"] = strings_part(f), sparse_part(f), bytes_part(f)
    if f.peek_tag() != GRAPH_TAG:
        n = block(f, False)
        if n:
            end = f.at + n
            if f.peek_tag() == METADATA_TAG:  # no block of samples: this is the metadata
                f.at -= 8
            else:
                out["da"] = {"marked": bits_part(f), "ranges": sparse_part(f), "offsets": sparse_part(f), "array": ints_part(f)}
                f.at = end
    if f.peek_tag() != GRAPH_TAG:
        n = block(f, bool(out["index"]["flags"] & INDEX_METADATA))
        if n:
            end = f.at + n
            out["metadata"] = header(f, METADATA_TAG, ("samples", "haplotypes", "contigs", "flags"))
            count = f.take()[0]
            out["paths"] = {"n": count, "at": f.skip(16 * count)}
            for name in ("samples", "contigs"):
                out[name] = strings_part(f)
                ints_part(f)  # ids in order of names
            if f.at != end:
                raise ValueError("metadata: sizes disagree")
    if bool(out["index"]["flags"] & INDEX_METADATA) != ("metadata" in out):
        raise ValueError("the index header and the metadata block disagree")
    if f.peek_tag() == GRAPH_TAG:
        out["graph"] = header(f, GRAPH_TAG, ("nodes", "flags"))
    else:  # left out: one node for each symbol past the offset
        out["graph"] = {"version": 3, "nodes": out["index"]["alphabet"] - out["index"]["offset"], "flags": 0}
    if out["graph"]["version"] > 3 and out["graph"]["flags"] & GRAPH_ZSTD:
        out["sequences"] = {"index": sparse_part(f), "n": f.take()[0], "zstd": bytes_part(f)}
    else:
        out["sequences"] = strings_part(f)
    out["segments"], out["mapping"] = strings_part(f), sparse_part(f)
    return out


def size(parts: dict, module: str) -> int:
    """Entries of a module that can be cut into ranges; 1 for the small ones."""
    if module in ("records", "record_bytes"):
        return parts["starts"]["low"]["n"]
    if module == "packed":
        return parts["sequences"]["index"]["low"]["n"]
    if module in ("sequences", "segments", "samples", "contigs"):
        return parts[module]["index"]["low"]["n"] if module in parts else 0
    if module == "paths":
        return parts["paths"]["n"] if "paths" in parts else 0
    return 1


def entries(f: Words, parts: dict, module: str, lo: int, hi: int) -> Iterator[tuple]:
    """Rows lo to hi of a module, in the order of its columns."""
    if module == "headers":
        for name in ("container", "index", "metadata", "graph"):
            if name in parts:
                h = parts[name]
                yield name, h["version"], {k: v for k, v in h.items() if k not in ("version", "flags")}, h["flags"]
    elif module == "tags":
        for name in ("container", "index"):
            part = parts[f"{name}_tags"]
            flat = string_slice(f, part, 0, part["index"]["low"]["n"])
            for k, v in dict(zip(flat[::2], flat[1::2])).items():  # an odd item has no value; the last of a key stays
                yield name, k, v
    elif module in ("records", "record_bytes"):
        ends = bounds(f, parts["starts"], lo, hi, parts["records"]["n"]).tolist()
        for i, (a, b) in enumerate(zip(ends, ends[1:]), lo):
            data = f.bytes_at(parts["records"]["at"] + a, b - a)
            if module == "record_bytes":
                yield i, data
                continue
            outgoing, runs = codec.decode_record(data)
            yield i, len(outgoing), data, outgoing, runs
    elif module == "packed":
        part = parts["sequences"]
        if "zstd" in part:
            raise ValueError("labels in a compressed block have no packed form to read")
        yield from packed_slice(f, part, lo, hi)
    elif module == "paths":
        for i, row in enumerate(f.words_at(parts["paths"]["at"] + 16 * lo, 2 * (hi - lo)).view("<u4").reshape(-1, 4).tolist(), lo):
            yield i, *(None if x == NO_VALUE else x for x in row)
    elif module == "da_samples":
        if "da" in parts:
            d = parts["da"]
            for name, values in (("marked", set_positions(f, d["marked"], 0, d["marked"]["ones"])), ("ranges", sparse_slice(f, d["ranges"], 0, d["ranges"]["low"]["n"])), ("offsets", sparse_slice(f, d["offsets"], 0, d["offsets"]["low"]["n"])), ("array", int_slice(f, d["array"], 0, d["array"]["n"]))):
                yield from ((name, i, int(x)) for i, x in enumerate(values.tolist()))
    else:
        names = string_slice(f, parts[module], lo, hi)
        if module == "segments":
            yield from ((i, s, a) for i, (s, a) in enumerate(zip(names, sparse_slice(f, parts["mapping"], lo, hi).tolist(), strict=True), lo))
        else:
            first = lo + (module == "sequences")  # node ids begin at 1
            yield from enumerate(names, first)


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, module: str, rows: int, first: int, last: int | None):
        self.path, self.module, self.rows, self.first, self.last = path, module, rows, first, last

    def partitions(self):
        n = size(layout(Words(self.path)), self.module)
        stop = n if self.last is None else min(n, self.last + 1)
        return [Range(a, min(a + self.rows, stop)) for a in range(self.first, stop, self.rows)] or [Range(0, 0)]

    def read(self, partition):
        if partition.hi > partition.lo:
            f = Words(self.path)
            yield from entries(f, layout(f), self.module, partition.lo, partition.hi)


class ContainerSource(DataSource):
    """Options: path, module (one of MODULES), rows (entries a task), first and last (entries from and to, from 0)."""

    @classmethod
    def name(cls):
        return "graph_container"

    def schema(self):
        return MODULES[self.options.get("module", "headers")]

    def reader(self, schema):
        return ContainerReader(self.options["path"], self.options.get("module", "headers"), int(self.options.get("rows", ROWS_A_TASK)), int(self.options.get("first", 0)), int(self.options["last"]) if "last" in self.options else None)


def read(spark, path: str, module: str, rows: int = ROWS_A_TASK, first: int = 0, last: int | None = None) -> DataFrame:
    """A module, or its entries from first to last alone: a look-up reads no other bytes of the body."""
    spark.dataSource.register(ContainerSource)
    source = spark.read.format("graph_container").option("module", module).option("rows", rows).option("first", first)
    return (source if last is None else source.option("last", last)).load(path)


def load(spark, path: str, without: tuple[str, ...] = ("record_bytes", "packed")) -> dict[str, DataFrame]:
    """All modules but some, lazily: none is read before an action on it."""
    return {m: read(spark, path, m) for m in MODULES if m not in without}


def stages(path: str) -> list[tuple[str, int]]:
    """The parts of a file with a body, in order, and where each body begins."""
    parts = layout(Words(path))
    places = [("container_tags", parts["container_tags"]["chars"]["at"]), ("index_tags", parts["index_tags"]["chars"]["at"]), ("records", parts["records"]["at"])]
    places += [(m, parts[m]["at"]) for m in ("paths",) if m in parts]
    label = parts["sequences"]
    places += [("sequences", (label["zstd"] if "zstd" in label else label["chars"])["at"]), ("segments", parts["segments"]["chars"]["at"])]
    return sorted(places, key=lambda p: p[1])


def label(spark, path: str, node: int) -> str | None:
    rows = read(spark, path, "sequences", first=node - 1, last=node - 1).collect() if node > 0 else []
    return rows[0].seq if rows else None


def predicates(headers: DataFrame) -> DataFrame:
    """module and what its flags say: simple, metadata, bidirectional (index), translation, zstd (graph, from version 4)."""
    on = lambda module, bit: F.when(F.col("module") == module, F.col("flags").bitwiseAND(bit) != 0)
    zstd = F.when(F.col("module") == "graph", (F.col("flags").bitwiseAND(GRAPH_ZSTD) != 0) & (F.col("version") > 3))
    return headers.select("module", on("index", INDEX_SIMPLE).alias("simple"), on("index", INDEX_METADATA).alias("metadata"), on("index", INDEX_BIDIRECTIONAL).alias("bidirectional"), on("graph", GRAPH_TRANSLATION).alias("translation"), zstd.alias("zstd"))


def described(headers: DataFrame) -> DataFrame:
    """module and its header as text: version and fields, by name, with thousands separated."""
    fields = F.array_sort(F.map_entries("fields"))
    text = F.array_join(F.transform(fields, lambda x: F.concat(x["key"], F.lit("="), F.format_number(x["value"], 0))), ", ")
    return headers.select("module", F.concat(F.col("module"), F.lit(" v"), F.col("version").cast("string"), F.lit(", "), text).alias("text"))


def broken(spark, path: str, count: int = 1000) -> DataFrame:
    """How many of the first records are read and how many of them are broken."""
    rows = read(spark, path, "record_bytes", last=count - 1).select(codec.record_valid(F.col("data")).alias("valid"))
    return rows.agg(F.count("*").alias("records"), F.count_if(~F.col("valid")).alias("broken"))


def edge_count(records: DataFrame, record_id: int) -> DataFrame:
    return records.where(F.col("record_id") == record_id).select(F.size("outgoing").cast("bigint").alias("edges"))


def edges(records: DataFrame) -> DataFrame:
    """record_id, outrank, to, support (the visits that take the edge) of all edges. Edges and runs are listed apart: a
    record's runs beside each of its edges are their product, and where the walks begin both are many."""
    runs = records.select("record_id", F.explode("runs").alias("r")).groupBy("record_id", F.col("r.outrank").alias("outrank")).agg(F.sum("r.len").alias("support"))
    own = records.select("record_id", F.posexplode("outgoing").alias("outrank", "o")).select("record_id", F.col("outrank").cast("bigint").alias("outrank"), F.col("o.to").alias("to"))
    return own.join(runs, ["record_id", "outrank"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("bigint")))


def edge_target(records: DataFrame, record_id: int, edge: int) -> DataFrame:
    """Target of one edge (from 0) of one record; no row if there is no such edge."""
    return records.where((F.col("record_id") == record_id) & (F.size("outgoing") > edge)).select(F.get("outgoing", F.lit(edge))["to"].alias("to"))


def chunks(spark, path: str, size: int = 1 << 20) -> DataFrame:
    """A small file's bytes in chunks: chunk, data."""
    whole = spark.read.format("binaryFile").load(path)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((length - 1) div {size} as int)"))))
    return whole.where("length > 0").select("content", at.alias("chunk")).select("chunk", F.expr(f"substring(content, chunk * {size} + 1, {size})").alias("data"))


# Writing. A part is a list of byte strings.


def words(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}Q", *values)


def ints_bytes(values: np.ndarray, width: int) -> bytes:
    values = np.asarray(values, np.uint64)
    bits = np.zeros((len(values), width), np.uint8)
    for k in range(width):
        bits[:, k] = values >> np.uint64(k) & np.uint64(1)
    n = -(-len(values) * width // 64)
    return words(len(values), width, len(values) * width, n) + np.packbits(bits.ravel(), bitorder="little").tobytes().ljust(8 * n, b"\0")


def bits_bytes(positions: np.ndarray, length: int) -> bytes:
    n = -(-length // 64)
    bits = np.zeros(64 * n, np.uint8)
    bits[positions] = 1
    return words(len(positions), length, n) + np.packbits(bits, bitorder="little").tobytes() + words(0, 0, 0)


def sparse_bytes(values) -> bytes:
    """Elias-Fano: low parts of floor(log2(universe / n)) bits, one at least; high parts in unary."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return words(0) + bits_bytes(np.zeros(0, np.int64), 0) + ints_bytes(values, 64)
    universe = int(values[-1]) + 1
    width = max(1, max(universe // len(values), 1).bit_length() - 1)
    length = universe + (1 << width) - 1 >> width
    high = (values >> width) + np.arange(len(values))
    return words(universe) + bits_bytes(high, length + len(values)) + ints_bytes(values & (1 << width) - 1, width)


def blob(data: bytes) -> bytes:
    return words(len(data)) + data.ljust(-(-len(data) // 8) * 8, b"\0")


def least_width(n: int) -> int:
    return max(1, n.bit_length())


def starts(lengths) -> np.ndarray:
    ends = np.cumsum(np.asarray(lengths, np.int64))
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends


def strings_bytes(items: list[str]) -> bytes:
    raw = [s.encode() for s in items]
    data = np.frombuffer(b"".join(raw), np.uint8)
    alphabet, codes = np.unique(data, return_inverse=True)
    return sparse_bytes(starts([len(s) for s in raw])) + blob(alphabet.tobytes()) + ints_bytes(codes, least_width(max(len(alphabet) - 1, 0)))


def zstd_bytes(items: list[str]) -> bytes:
    raw = [s.encode() for s in items]
    data = b"".join(raw)
    return sparse_bytes(starts([len(s) for s in raw])) + words(len(data)) + blob(pa.compress(data, "zstd", asbytes=True))


def dictionary_bytes(names: list[str]) -> bytes:
    return strings_bytes(names) + ints_bytes(np.array(sorted(range(len(names)), key=names.__getitem__), np.uint64), least_width(max(len(names) - 1, 0)))


def tags_bytes(tags: dict[str, str]) -> bytes:
    return strings_bytes([x for k, v in tags.items() for x in (k.lower(), v)])


def da_bytes(rows: list[tuple[str, int]]) -> bytes:
    """The block of samples, from (part, value) in order: marked records, ranges, offsets and the array."""
    own = {name: [v for p, v in rows if p == name] for name in ("marked", "ranges", "offsets", "array")}
    array = np.array(own["array"], np.uint64)
    marked = np.array(own["marked"], np.int64)
    out = bits_bytes(marked, int(marked[-1]) + 1 if len(marked) else 0) + sparse_bytes(own["ranges"]) + sparse_bytes(own["offsets"]) + ints_bytes(array, least_width(int(array.max()) if len(array) else 0))
    return words(len(out) // 8) + out


def write(
    path: str, records: DataFrame, sequences: DataFrame, paths: DataFrame | None = None, samples: DataFrame | None = None, contigs: DataFrame | None = None, segments: DataFrame | None = None, tags: dict | None = None, index_tags: dict | None = None, offset: int = 1, bidirectional: bool = True, zstd: bool = True, da_samples: DataFrame | None = None
) -> None:
    """Write a container. The format is one sequential file, so the driver writes it. Records come encoded from the
    executors, in order of record_id, and are written as they come; of them the driver holds their lengths, of
    the other modules all. Larger graphs belong in Parquet."""
    column = lambda df, key, *names: [tuple(r) for r in df.orderBy(key).select(*names).toLocalIterator()]
    encoded = cut(records.select("record_id", codec.record_bytes(F.col("outgoing"), F.col("runs")).alias("data")))
    in_order = encoded.orderBy("record_id")  # a table that is read again comes by the size of its files
    lengths = [r[0] for r in in_order.select(F.length("data")).toLocalIterator()]
    total = records.select(F.sum(codec.run_total(F.col("runs")))).first()[0] or 0
    meta = b""
    rows = []
    if paths is not None:
        rows = [[NO_VALUE if x is None else x for x in r] for r in column(paths, "path_id", "sample", "contig", "phase", "fragment")]
        names = [[r[0] for r in column(df, "id", "name")] if df is not None else [] for df in (samples, contigs)]
        haplotypes = len({(r[0], r[2]) for r in rows})
        meta = words(METADATA_TAG | 2 << 32, len(names[0]), haplotypes, len(names[1]), 0) + words(len(rows)) + np.array(rows, "<u4").tobytes() + b"".join(map(dictionary_bytes, names))
    labels = [r[0] for r in column(sequences, "node_id", "seq")]
    places = column(segments, "start_node", "name", "start_node") if segments is not None else []
    flags = INDEX_SIMPLE | (INDEX_BIDIRECTIONAL if bidirectional else 0) | (INDEX_METADATA if meta else 0)
    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(name) as out:
        out.write(words(CONTAINER_TAG | 1 << 32, 0) + tags_bytes(tags or {}))
        out.write(words(INDEX_TAG | 5 << 32, len(rows) * (2 if bidirectional else 1), total, offset, len(lengths) + offset, flags) + tags_bytes(index_tags or {}))
        out.write(sparse_bytes(starts(lengths)) + words(sum(lengths)))
        for r in in_order.select("data").toLocalIterator():
            out.write(bytes(r[0]))
        out.write(bytes(-sum(lengths) % 8))
        da = [(r.part, r.value) for r in da_samples.orderBy("part", "idx").collect()] if da_samples is not None else []
        out.write((da_bytes(da) if da else words(0)) + words(len(meta) // 8) + meta)
        out.write(words(GRAPH_TAG | (4 if zstd else 3) << 32, len(labels), (GRAPH_TRANSLATION if places else 0) | GRAPH_ZSTD))
        out.write(zstd_bytes(labels) if zstd else strings_bytes(labels))
        out.write(strings_bytes([p[0] for p in places]) + sparse_bytes([p[1] for p in places]))
