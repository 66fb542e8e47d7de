"""Near-duplicate vectors: all links of each label, by exact comparison in cells.

A label's vectors of one length are dealt to cells by their nearest pivot (by the angle); the pivots are
a sample of the vectors themselves, one in CELL by a hash. Two linked unit vectors are no further
apart than EPS = sqrt(2 - 2 cosine), so a partner of a member of cell p that lies nearer to pivot q is
within EPS of the plane between p and q. Each vector is therefore a guest of every lower cell whose
plane is that near: each linked pair meets in just one cell, and none is missed. In a cell, members meet
members and guests in blocks of about BLOCK elements, by a matrix product in double precision. A block
pair gives each vector's number of links and a spanning star of each of its linked sets, not the pairs.

The work is the square of a label's size, less what the planes cut off: much where vectors form
separate groups, little in a label whose vectors all lie close together. Nothing is bounded or sampled.

Equal vectors of a label are one class, compared once and counted by their number. Vectors that are
null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing.
Vectors of different lengths never link. Null vec_ids: such rows link and count but cannot name a
component. Repeated rows are equal vectors. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, tune

COSINE, CELL, BLOCK = 0.98, 4096, 1 << 16
#: Far above the rounding of a product of unit vectors, and far below any distance that matters.
SLACK = 1e-6


def unit(rows: list, width: int) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, member): the home cell of each row, and the lower cells that it is a guest of."""
    eps = np.sqrt(max(2 - 2 * cosine, 0))
    near = x @ pivots.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    own = near[np.arange(len(x)), home]
    row, cell = np.nonzero((own[:, None] - near <= (eps + SLACK) * apart[home] + SLACK) & (np.arange(len(pivots)) <= home[:, None]))
    return row, cell, cell == home[row]


def _deal(pivots: dict, cosine: float):
    """Each vector in its home cell and as a guest in others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                vectors = b.column(3).to_pylist()
                own: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(b.column(0).to_pylist(), map(len, vectors), strict=True)):
                    own.setdefault(key, []).append(i)
                for (label, width), rows in own.items():
                    take = np.array(rows)
                    if (label, width) in pivots:
                        row, cell, member = cells(unit([vectors[i] for i in rows], width), pivots[label, width], cosine)
                    else:
                        row, cell, member = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                    for at in range(0, len(row), 4096):
                        out = b.take(pa.array(take[row[at : at + 4096]]))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell[at : at + 4096].astype(np.int32)), pa.array(member[at : at + 4096])], names=[*b.schema.names, "cell", "member"])

    return run


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches by the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(cosine: float):
    """A pair of blocks (left, right; right alone if they are one): links of each vector, and stars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = len(pdf["embedding"].iloc[0])
        x, node, n = unit(pdf["embedding"].tolist(), width), pdf["node"].to_numpy(), pdf["n"].to_numpy()
        left, right = np.flatnonzero(pdf["side"] == 0), np.flatnonzero(pdf["side"] == 1)
        same = not len(left) and pdf["same"].iloc[0]
        left = right if same else left
        links, low = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for at in range(0, len(left), 1024):
            l = left[at : at + 1024]
            near = x[l] @ x[right].T >= cosine
            if same:
                near[np.arange(len(l)), at + np.arange(len(l))] = False
            links[l] += near @ n[right]
            if not same:
                links[right] += n[l] @ near
            a, b = np.nonzero(near)
            if len(a):
                more = stars(len(pdf), l[a], right[b])
                low = stars(len(pdf), np.concatenate([np.arange(len(pdf))] * 2), np.concatenate([low, more]))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": node[hit], "links": links[hit], "low": node[low[hit]]})

    return run


def pivots_of(classes: DataFrame, cell: int) -> dict:
    """Unit vectors by label and length: a sample of those with more than cell classes."""
    sizes = classes.groupBy("label", F.size("embedding").alias("width")).agg(F.count("*").alias("m")).where(F.col("m") > cell)
    some = classes.withColumn("width", F.size("embedding")).join(sizes, ["label", "width"]).where(F.pmod(F.xxhash64("embedding"), F.lit(cell)) == 0)
    out: dict[tuple, list] = {}
    for r in some.select("label", "width", "embedding").collect():
        out.setdefault((r[0], r[1]), []).append(r[2])
    return {k: unit(sorted(v), k[1]) for k, v in out.items()}


def links_of(classes: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(node, links, low) of classes (label, node, n, embedding): a row for each block pair in which a node
    has links; low is a node that those links connect it with."""
    schema = classes.schema.simpleString()[7:-1].replace(":", " ").replace("array ", "array")
    dealt = materialize(classes.mapInArrow(_deal(pivots_of(classes, cell), cosine), f"{schema}, cell int, member boolean"), "cells").withColumn("width", F.size("embedding"))
    place = ["label", "width", "cell"]
    sizes = dealt.groupBy(*place).agg(F.coalesce(F.ceil(F.sum(F.when(F.col("member"), F.col("width"))) / block), F.lit(0)).cast("int").alias("m"), F.coalesce(F.ceil(F.sum(F.when(~F.col("member"), F.col("width"))) / block), F.lit(0)).cast("int").alias("g"))
    rows = dealt.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("member"), F.col("m")).otherwise(F.col("g"))).cast("int"))
    # a member's block meets the members' blocks 0 to m - 1 and the guests' blocks m to m + g - 1
    rows = rows.where("m > 0").withColumn("at", F.when(F.col("member"), F.col("block")).otherwise(F.col("m") + F.col("block")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("m") + F.col("g")).otherwise(F.col("m")) - 1)))
    rows = rows.select(*place, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.when(F.col("at") >= F.col("other"), 1).otherwise(0).alias("side"), (F.col("at") == F.col("other")).alias("same"), "node", "n", "embedding")
    return rows.groupBy(*place, "i", "j").applyInPandas(_compare(cosine), "node bigint, links bigint, low bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    tune(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding")
    finite = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    valid = F.coalesce(finite, F.lit(False))
    classes = rows.where(valid).withColumn("embedding", F.expr("transform(embedding, x -> x + 0)")).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = materialize(links_of(classes.select("label", "node", "n", "embedding"), cosine, cell, block), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "low"))
    classes = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(names, "component").join(links, "node", "left").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    clean = rows.withColumn("_valid", valid).withColumn("_same", F.when(F.col("_valid"), F.expr("transform(embedding, x -> x + 0)")))
    out = clean.join(named, (clean["label"] == named["_label"]) & (clean["_same"] == named["_embedding"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
