"""Exact deduplication by content-defined chunk recipes.

Each text, without the white-space characters ``[\\x20\\x09-\\x0D]``, is cut where a rolling
hash of its last 32 bytes says so, so that equal texts are cut alike. A chunk is named by a
128-bit digest; the names are verified by grouping the distinct chunk contents themselves,
once. After that a document is its recipe, the ordered list of chunk identifiers, and only
recipes are compared. Long texts move at most once, and repeated chunks of a task not at all.
If two different chunks ever share a name, the documents with such a chunk are compared by the
SHA-256 of their whole normalised text instead.

Null texts count as empty; all empty or white-space-only texts are equal to each other. Null
doc_ids lose ties. Repeated rows are one group; in ``exact_groups`` rows of a group that share the kept doc_id all count
as kept, of which ``exact_dedup`` keeps one. Extra columns are ignored by ``exact_groups``; ``exact_dedup`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, one_row_each, slices, texts, tune

SPACES = bytes([0x20, *range(0x09, 0x0E)])
AVERAGE_BITS, LEAST, MOST = 12, 1024, 65536
#: A random 32-bit number for each byte value.
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, 256, dtype=np.uint32)


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes allows a cut."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):  # doubling: h covers 2k bytes after the step
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return np.flatnonzero((h >> np.uint32(32 - AVERAGE_BITS)) == 0) + 1


def chunks(data: bytes) -> list[bytes]:
    """The content-defined chunks of data; empty data is one empty chunk."""
    if len(data) <= LEAST:
        return [data]
    out, start = [], 0
    for c in cuts(np.frombuffer(data, np.uint8)).tolist():
        while c - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if c - start >= LEAST and c < len(data):
            out.append(data[start:c])
            start = c
    while len(data) - start > MOST:
        out.append(data[start : start + MOST])
        start += MOST
    out.append(data[start:])
    return out


def normalized(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACES)


def _recipes(name: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: dict[str, list] = {"n_cp": [], "sha": [], "recipe": []}
            for t in texts(b):
                data = normalized(t)
                rows["n_cp"].append(len(t))
                rows["sha"].append(hashlib.sha256(data).hexdigest())
                rows["recipe"].append(b"".join(map(name, chunks(data))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows["n_cp"], pa.int64()), pa.array(rows["sha"]), pa.array(rows["recipe"], pa.binary())], names=["doc_id", "h", "n_cp", "sha", "recipe"])

    return run


def _contents(name: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[bytes, bytes]] = set()  # what this task has sent already, bounded; a repeat does no harm
        for b in slices(batches):
            out: dict[tuple[bytes, bytes], bytes] = {}
            for t in texts(b):
                for c in chunks(normalized(t)):
                    key = (name(c), hashlib.blake2b(c, digest_size=16).digest())
                    if key not in sent:
                        out[key] = c
            if len(sent) > 200_000:
                sent.clear()
            sent.update(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.binary()), pa.array(list(out.values()), pa.binary())], names=["id", "chunk"])

    return run


def recipes(docs: DataFrame, name: Callable[[bytes], bytes] = digest) -> DataFrame:
    """doc_id, h (hash of the text as it is), n_cp, sha, recipe: equal recipes if and only if equal normalised texts.

    name gives a chunk's identifier; tests pass a weak one to force collisions.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    out = materialize(docs.mapInArrow(_recipes(name), "doc_id bigint, h bigint, n_cp bigint, sha string, recipe binary"), "recipes")
    # verification: one content for each identifier
    distinct = docs.select("text").mapInArrow(_contents(name), "id binary, chunk binary").groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    bad = materialize(distinct.groupBy("id").count().where("count > 1").select("id"), "ambiguous")
    if bad.isEmpty():
        return out
    # an ambiguous name makes every recipe suspect that it is part of: those compare by their whole text
    length = len(name(b""))
    parts = out.select("recipe").distinct().select("recipe", F.explode(F.expr(f"transform(sequence(1, greatest(1, length(recipe)), {length}), i -> substring(recipe, i, {length}))")).alias("id"))
    suspect = parts.join(bad, "id", "left_semi").select("recipe").distinct()
    return out.join(suspect.withColumn("suspect", F.lit(True)), "recipe", "left").select("doc_id", "h", "n_cp", "sha", F.when(F.col("suspect"), F.concat(F.lit(b"whole:"), F.unhex("sha"))).otherwise(F.col("recipe")).alias("recipe"))


#: A group of more rows than HOT, and than one in GROUPS of all, is joined by broadcast: there are fewer than
#: GROUPS of these, with recipes of at most SHORT bytes. Longer ones stay in the join by recipe, which AQE splits.
HOT, GROUPS, SHORT = 1000, 10_000, 1024


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of their recipe's group (recipe, group_size, ...). Large groups do not go to one task."""
    groups = materialize(groups, "groups")
    least = max(HOT, (groups.agg(F.sum("group_size")).first()[0] or 0) // GROUPS)
    large = (F.col("group_size") > least) & (F.length("recipe") <= SHORT)
    names = [c for c in groups.columns if c != "recipe"]
    marked = rows.join(F.broadcast(groups.where(large)), "recipe", "left")  # bounded, as said above
    rest = marked.where("group_size is null").drop(*names).join(groups.where(~large), "recipe")
    return marked.where("group_size is not null").unionByName(rest)


def exact_groups(docs: DataFrame, name: Callable[[bytes], bytes] = digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text, then the smallest
    doc_id, stays. Among fully equal rows with one doc_id, all count as kept.
    """
    rows = recipes(docs, name)
    best = rows.groupBy("recipe").agg(F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best"), F.count("*").alias("group_size"))
    return with_groups(rows, best.select("recipe", F.col("best.id").alias("keep_id"), "group_size")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each group, with all their columns."""
    rows = recipes(docs)
    best = rows.groupBy("recipe").agg(F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    return one_row_each(docs, rows, best.select("best.doc_id", "best.h"))
