"""SimHash near-duplicate groups by anchor-point covering.

A text's fingerprint has bit i set if more than half of its shingles' XXH64 hashes have it set.
Fingerprints within 2 differing bits must meet. Anchors are the words of a covering code: two
copies of the binary Golay code [23, 12] (covering radius 3 each) on bits 0 to 45; bits 46 to 63
take no part. A fingerprint's home is the anchor that both halves decode to. If x and y differ in
at most 2 bits, y lies within covering radius plus 2 of x's home; of those anchors y is
replicated to the ones that really are the home of something within 2 bits of it (about 61 of
2^24). So each pair meets at the home of its smaller member, and only there: links are complete
and found once, whatever the fingerprints are. Equal fingerprints are collapsed before, and
links are verified inside the join of homes and replicas, whose hot anchors AQE can split.

Null texts count as empty. Texts without words have fingerprint zero and link like others.
Repeated rows share a fingerprint. Null doc_ids get a class like others but cannot name it. Empty
tables give no rows. Extra columns are ignored by ``near_groups`` and kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, one_row_each, slices, texts, tune

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: The Golay code's generator polynomial x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR, LENGTH, PARITY = 0b101011100011, 23, 11

PLACES = 256 * np.arange(8, dtype=np.int64)
BITS = np.arange(256)[:, None] >> np.arange(8) & 1


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each k-word shingle (A-Z lower-cased, words split at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(8 * 256, np.int64)  # how often each byte value stands at each of the 8 places
    for at in range(0, len(hashes), 65536):  # bounded for very long texts
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        counts += np.bincount((part + PLACES).ravel(), minlength=8 * 256)
    bits = np.packbits(2 * (counts.reshape(8, 256) @ BITS) > len(hashes), axis=1, bitorder="little").ravel()
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.array([fingerprint(shingle_hashes(t)) for t in texts(b)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])


def remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: the words as polynomials modulo the generator."""
    out = np.array(words, np.int64)
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - PARITY)), out)
    return out


@cache
def tables() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """leader: for each syndrome the error of weight 3 or less that decoding undoes.
    near: for each syndrome and cost 0, 1, 2, the xor masks from a word to the codewords that
    become its home by flipping so many bits at least."""
    one = [1 << i for i in range(LENGTH)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b for a in two for b in one if b > a]
    errors = np.array([0, *one, *two, *{*three}], np.int64)
    leader = np.zeros(1 << PARITY, np.int64)
    leader[remainder(errors)] = errors
    near = []
    flips = [np.array(x, np.int64) for x in ([0], one, two)]
    flip_syndromes = [remainder(x) for x in flips]
    for s in range(1 << PARITY):
        seen = np.zeros(0, np.int64)
        own = []
        for f, fs in zip(flips, flip_syndromes, strict=True):
            masks = np.setdiff1d(f ^ leader[s ^ fs], seen)
            seen = np.concatenate([seen, masks])
            own.append(masks)
        near.append(own)
    return leader, near


def anchor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 24-bit number for a pair of codewords: their information bits."""
    return (a >> PARITY) << (LENGTH - PARITY) | (b >> PARITY)


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (fps.view(np.uint64) & np.uint64((1 << 2 * LENGTH) - 1)).astype(np.int64)
    return low & ((1 << LENGTH) - 1), low >> LENGTH


def homes(fps: np.ndarray) -> np.ndarray:
    leader, _ = tables()
    a, b = halves(fps)
    return anchor(a ^ leader[remainder(a)], b ^ leader[remainder(b)])


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) of all anchors that it is replicated to."""
    _, near = tables()
    a, b = halves(fps)
    out, counts = [], []
    for x, y, sx, sy in zip(a.tolist(), b.tolist(), remainder(a).tolist(), remainder(b).tolist(), strict=True):
        (a0, a1, a2), (b0, b1, b2) = near[sx], near[sy]
        ax, by = (np.concatenate([a0, a1, a2]) ^ x) >> PARITY, (np.concatenate([b0, b1, b2]) ^ y) >> PARITY
        p, q = len(a0), len(a0) + len(a1)
        r, s = len(b0), len(b0) + len(b1)
        # cost of the first half plus cost of the second is 2 at most
        own = np.concatenate([(ax[:p, None] << 12 | by[None, :]).ravel(), (ax[p:q, None] << 12 | by[None, :s]).ravel(), (ax[q:, None] << 12 | by[None, :r]).ravel()])
        out.append(own)
        counts.append(len(own))
    return np.repeat(np.arange(len(fps)), counts), np.concatenate(out) if out else np.zeros(0, np.int64)


def _homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(homes(b.column(0).to_numpy()).astype(np.int32)), b.column(0), b.column(1)], names=["anchor", "fp", "rep"])


def _replicas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            i, anchors = replicas(b.column(0).to_numpy())
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["anchor", "fp", "rep"])


def links(classes: DataFrame) -> DataFrame:
    """(a, b): representatives of the fingerprints (fp, rep) that differ in 1 or 2 bits, each pair once. Spark takes the
    replicas for as small as the classes' files, so that it must be told not to send them through the driver."""
    schema = "anchor int, fp bigint, rep bigint"
    h = classes.select("fp", "rep").mapInArrow(_homes, schema).alias("h")
    r = classes.select("fp", "rep").mapInArrow(_replicas, schema).alias("r")
    close = F.expr(f"h.anchor = r.anchor and h.fp < r.fp and bit_count(h.fp ^ r.fp) <= {THRESHOLD}")
    return h.join(r.hint("merge"), close).select(F.col("h.rep").alias("a"), F.col("r.rep").alias("b"))


def grouped(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), fp, node (one for each group), component_id. Every join here has
    sides that grow with the documents, in files much smaller than their rows: none may go through the driver."""
    tune(docs.sparkSession)
    fps = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_fingerprints, "doc_id bigint, h bigint, fp bigint"), "fingerprints")
    # classes are named by a number of their own, as all their doc_ids may be null
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = components(links(classes))
    classes = classes.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("node"))
    # a table, so that AQE can split the node of a large group
    names = materialize(classes.groupBy("node").agg(F.min("least").alias("component_id")), "names")
    return fps.join(classes.join(names.hint("merge"), "node").select("fp", "node", "component_id").hint("merge"), "fp")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each group (its smallest doc_id; null if it has no other), with all their columns."""
    rows = materialize(grouped(docs).select("doc_id", "h", "node"), "groups")
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    return one_row_each(docs, rows, best.select("best.doc_id", "best.h"))
