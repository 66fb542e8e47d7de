"""Vector best-fit packing of documents into token sequences.

Documents are tokenised whole, get an end id and are cut into pieces of CAPACITY tokens only if
longer. A bin has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece goes to an open bin that has room for it under every constraint:
the one with the greatest weighted dot product of the piece's and the bin's load vectors, ties by
the least weighted norm of what would stay free, then by age. Pieces come by falling length.

Pieces, which are narrow rows, are dealt round into tasks of about GROUP pieces; each task packs
its own bins, so no key can fill a task, memory is bounded and only about one bin a task stays open.
A task that gets four times as many pieces as it was dealt packs what it has and goes on with new bins.
Null texts are an end id alone; null doc_ids are carried along; repeated rows are packed each.
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder, tokenizer_path
from .common import BATCH_BYTES, materialize, slices, tune

CAPACITY, END = 2048, 0
GROUP = 8192
#: Weights of tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.05, 0.2)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, most_docs: int | None = None, most_cost: float | None = None, weights: tuple = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. No bin has more than capacity tokens, most_docs pieces or
    most_cost attention cost (a single piece may exceed the cost: it then has its bin alone)."""
    most_docs = most_docs or capacity
    most_cost = float(most_cost or capacity * capacity)
    n = len(lengths)
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if (lengths > capacity).any() or (lengths < 1).any():
        raise ValueError("a piece is empty or longer than a sequence")
    # open bins: residual tokens, documents, cost; room for one more in every array
    tok, docs, cost, name = (np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1), np.zeros(n + 1, np.int64))
    used, made = 0, 0
    w = np.array(weights) / np.array([capacity, most_docs, most_cost])
    order = np.argsort(-lengths, kind="stable")
    rest = int(lengths.min()) if n else 0
    for i in order.tolist():
        size = int(lengths[i])
        square = float(size) * size
        k = -1
        if used:
            t, d, c = tok[:used], docs[:used], cost[:used]
            fits = np.flatnonzero((t >= size) & (d >= 1) & (c >= square))
            if len(fits):
                # loads are capacities less residuals, each weighted as a share of its capacity
                t, d, c = t[fits], d[fits], c[fits]
                dot = (capacity - t) * (size * w[0] / capacity) + (most_docs - d) * (w[1] / most_docs) + (most_cost - c) * (square * w[2] / most_cost)
                best = np.flatnonzero(dot >= dot.max() - 1e-12)
                if len(best) > 1:
                    norm = ((t[best] - size) * w[0]) ** 2 + ((d[best] - 1) * w[1]) ** 2 + ((c[best] - square) * w[2]) ** 2
                    best = best[norm.argmin() :]
                k = int(fits[best[0]])
        if k < 0:
            k = used
            tok[k], docs[k], cost[k], name[k] = capacity, most_docs, max(most_cost, square), made
            used, made = used + 1, made + 1
        bins[i], offsets[i] = name[k], capacity - tok[k]
        tok[k] -= size
        docs[k] -= 1
        cost[k] -= square
        if tok[k] < rest or docs[k] < 1:  # closed: the last open bin takes its place
            used -= 1
            tok[k], docs[k], cost[k], name[k] = tok[used], docs[used], cost[used], name[used]
    return bins, offsets


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, limit=BATCH_BYTES):
            ids, bounds = enc.flat(pc.fill_null(b.column(1), ""), end)
            size = np.diff(bounds)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            at = bounds[doc] + start
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity: int, most_docs: int | None, most_cost: float | None, group: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets = pack(t.column(3).to_numpy(), capacity, most_docs, most_cost)
            return pa.RecordBatch.from_arrays([*t.columns, pa.array((np.int64(task) << 40) + (np.int64(turn) << 20) + bins), pa.array(offsets)], names=[*t.schema.names, "sequence_id", "offset"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 4 * group:  # far more than was dealt: stay within memory
                yield flush()
                held, rows, turn = [], 0, turn + 1
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, most_docs: int | None = None, most_cost: float | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of capacity tokens fill a sequence and need no packing, but take part like others."""
    tune(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end), PIECE), "pieces")
    n = max(1, -(-pieces.count() // group))
    dealt = pieces.repartition(n)
    return dealt.mapInArrow(_pack(capacity, most_docs, most_cost, group), f"{PIECE}, sequence_id bigint, offset bigint")
