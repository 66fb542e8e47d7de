"""The binary container: parts against plain values, a whole file there and back."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.plans import files
from strandmap.sources import container as c


def opened(tmp_path, data):
    (tmp_path / "part").write_bytes(data)
    return c.Words(str(tmp_path / "part"))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 3], list(range(200)), [7, 1000, 1000, 10**12]])
def test_sparse(tmp_path, values):
    f = opened(tmp_path, c.sparse_bytes(values))
    part = c.sparse_part(f)
    assert f.at == f.size and c.sparse_slice(f, part, 0, len(values)).tolist() == values
    assert c.sparse_slice(f, part, len(values) // 2, len(values)).tolist() == values[len(values) // 2 :]


@pytest.mark.parametrize("width", [1, 3, 13, 64])
def test_ints(tmp_path, width):
    rng = random.Random(width)
    values = [rng.getrandbits(width) for _ in range(333)]
    f = opened(tmp_path, c.ints_bytes(np.array(values, np.uint64), width))
    part = c.ints_part(f)
    assert f.at == f.size and c.int_slice(f, part, 100, 301).tolist() == values[100:301]


@pytest.mark.parametrize("items", [[], [""], ["", "a", "", "bé"], ["ACGT", "NN", "A" * 100]])
def test_strings(tmp_path, items):
    f = opened(tmp_path, c.strings_bytes(items))
    part = c.strings_part(f)
    assert f.at == f.size and c.string_slice(f, part, 0, len(items)) == items
    assert c.string_slice(f, part, 1, len(items)) == items[1:]


@pytest.mark.parametrize("zstd", [True, False])
def test_round_trip(spark, tmp_path, zstd):
    path = str(tmp_path / f"graph-{zstd}")
    records = [(i, [(2, 0), (4 + i, i)] if i % 3 else [], [(0, 3), (1, 300), (0, 1)] if i % 3 else []) for i in range(20)]
    rec = spark.createDataFrame(records, "record_id bigint, outgoing array<struct<to:bigint,rank_offset:bigint>>, runs array<struct<outrank:bigint,len:bigint>>")
    seq = spark.createDataFrame([(i + 1, "ACGTN"[i % 5] * i) for i in range(10)], "node_id bigint, seq string")
    names = spark.createDataFrame([(0, "zed"), (1, "abe")], "id bigint, name string")
    paths = spark.createDataFrame([(0, 0, 1, 0, None), (1, 1, 0, None, 7)], "path_id bigint, sample bigint, contig bigint, phase bigint, fragment bigint")
    segs = spark.createDataFrame([("s1", 1), ("s2", 4)], "name string, start_node bigint")
    c.write(path, rec, seq, paths, names, names, segs, {"Source": "x"}, zstd=zstd)
    rows = lambda m: [tuple(r) for r in c.read(spark, path, m, rows=7).collect()]
    assert [(r[0], [tuple(x) for x in r[3]], [tuple(x) for x in r[4]]) for r in sorted(rows("records"))] == records
    assert sorted(rows("sequences")) == [tuple(r) for r in seq.collect()]
    assert sorted(rows("samples")) == [(0, "zed"), (1, "abe")]
    assert sorted(rows("paths"), key=str) == [(0, 0, 1, 0, None), (1, 1, 0, None, 7)]
    assert sorted(rows("segments")) == [(0, "s1", 1), (1, "s2", 4)]
    assert rows("tags") == [("container", "source", "x")] and rows("da_samples") == []
    assert [r[0] for r in rows("headers")] == ["container", "index", "metadata", "graph"]
    (tmp_path / "bad").write_bytes(b"x" * 64)
    with pytest.raises(ValueError):
        c.layout(c.Words(str(tmp_path / "bad")))


def test_samples_come_back(spark, tmp_path):
    path = str(tmp_path / "graph")
    rec = spark.createDataFrame([(0, [(2, 0)], [(0, 1)])], "record_id bigint, outgoing array<struct<to:bigint,rank_offset:bigint>>, runs array<struct<outrank:bigint,len:bigint>>")
    seq = spark.createDataFrame([(1, "ACGT")], "node_id bigint, seq string")
    rows = [("marked", 0, 1), ("marked", 1, 7), ("ranges", 0, 0), ("ranges", 1, 9), ("offsets", 0, 3), ("array", 0, 5), ("array", 1, 0), ("array", 2, 300)]
    c.write(path, rec, seq, da_samples=spark.createDataFrame(rows, "part string, idx bigint, value bigint"))
    assert sorted(tuple(r) for r in c.read(spark, path, "da_samples").collect()) == sorted(rows)
    assert [r.seq for r in c.read(spark, path, "sequences").collect()] == ["ACGT"]


def test_records_keep_their_order_over_many_files(spark, tmp_path):
    """Record i goes to node 2 * i + 2; the last records have the longest bytes, and so the largest files."""
    path = str(tmp_path / "graph")
    runs = F.expr("transform(sequence(0, cast(id * 3 as int)), x -> struct(cast(0 as bigint) as outrank, x + 1000L as len))")
    rec = spark.range(400).select(F.col("id").alias("record_id"), F.array(F.struct((2 * F.col("id") + 2).alias("to"), F.lit(0).cast("bigint").alias("rank_offset"))).alias("outgoing"), runs.alias("runs"))
    seq = spark.createDataFrame([(1, "ACGT")], "node_id bigint, seq string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        c.write(path, rec, seq)
    finally:
        spark.conf.set(key, before)
    got = {r.record_id: (r.outgoing[0].to, len(r.runs)) for r in c.read(spark, path, "records", rows=90).collect()}
    assert got == {i: (2 * i + 2, 3 * i + 1) for i in range(400)}


def test_edges_are_listed_without_their_runs(spark, monkeypatch):
    """An edge that no run takes has support 0; no edge's row holds the runs of its record."""
    rows = [(0, [(2, 0), (4, 0), (6, 1)], [(0, 3), (2, 1), (0, 4)]), (1, [], []), (2, [(0, 0)], [(0, 300)])]
    rec = spark.createDataFrame(rows, "record_id bigint, outgoing array<struct<to:bigint,rank_offset:bigint>>, runs array<struct<outrank:bigint,len:bigint>>")
    monkeypatch.setattr(files, "module", lambda *_: rec)
    out = files.container_edges(spark, "")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 2, 7), (0, 1, 4, 0), (0, 2, 6, 1), (2, 0, 0, 300)]
    listed = re.findall(r"Generate posexplode\([^)]*\), \[([^]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert listed and not any("runs" in x for x in listed)
