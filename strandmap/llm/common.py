"""Shared plumbing of the training-data operators: session settings, tables in the
shared folder, bounded Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import drop, materialize, new_path  # noqa: F401  (the operators take them from here)

#: Bytes of text that a Python worker holds at once, besides one oversized row.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
#: Edges up to which Spark may broadcast them, and so send them through the driver.
FEW_EDGES = 50_000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers: texts may be long. The settings must hold when
    the lazy results run, so they stay; smaller ones of the session are kept."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_each(docs: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs, with all columns, for each of keys (doc_id, h), h = xxhash64(text); rows has doc_id and
    h of every row of docs. Only rows that recur with doc_id and text are grouped, pre-aggregated."""

    def among(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_id"), F.col("h").alias("_k"))
        return df.join(some, df["doc_id"].eqNullSafe(some["_id"]) & (df["_h"] == some["_k"]), how)

    stay = among(docs.withColumn("_h", F.xxhash64("text")), keys, "left_semi")
    twice = materialize(rows.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "repeated")
    if not twice.isEmpty():
        stay = among(stay, twice, "left_anti").unionByName(among(stay, twice, "left_semi").dropDuplicates(["doc_id", "_h"]))
    return stay.drop("_h")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that each holds about limit bytes of the column (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size + 16)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _forest(batches: Iterable[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each bounded run of edges: (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= most:
            yield flush()
    yield flush()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable.

    edges has two bigint columns. Each partition first shrinks its edges to a forest;
    then large-star and small-star steps alternate (a logarithmic number in practice),
    each round a table in the shared folder. Minima are pre-aggregated, and the
    joins are plain equi-joins. Beyond FEW_EDGES their sides are tables of their own, joined by
    sort-merge: AQE can split their hot keys, and the driver gets no broadcast that grows with the
    edges. Nodes without edges are not returned. Besides, a count and a checksum reach the driver.
    """

    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.mapInArrow(_forest, "a bigint, b bigint").distinct(), "edges")
    state = tally(e)
    for _ in range(rounds):
        many = state[0] > FEW_EDGES
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = materialize(low, "least") if many else low
        large = both.where("b > a").join(low.hint("merge") if many else low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large") if many else large
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        low2 = materialize(low2, "least") if many else low2
        small = large.join(low2.hint("merge") if many else low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low2.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, "edges")
        for old in (e, low, large, low2):
            drop(old)
        e = new
        seen = tally(e)
        if seen == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
    raise RuntimeError("connected components did not settle")
