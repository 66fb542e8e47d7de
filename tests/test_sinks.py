"""The columnar sink and the synthetic graph against plain Python and the queries' SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandmap.plans import catalog
from strandmap.sources import block_rows, synthetic

SF = "/root/testdata/sf0.001"


def test_rows_come_back(spark, tmp_path):
    schema = "range_id bigint, ord bigint, node_id bigint, seq string, targets array<bigint>, is_start boolean, is_end boolean, rank_offsets array<int>"
    rows = [(0, 0, 7, "ACGT" * 9, [18, 21, 4], True, False, [0, 2, 5, 6]), (0, 1, 9, "", [], False, True, None), (3, 0, 10, None, None, True, True, [])]
    block_rows.write(spark.createDataFrame(rows, schema), str(tmp_path / "rows"))
    out = {r["node_id"]: r for r in block_rows.read(spark, str(tmp_path / "rows")).collect()}
    assert out[7]["edges"] == [9, 10, 2] and out[7]["edge_orientations"] == [2, 3, 2] and out[7]["seq"] == "ACGT" * 9
    assert (out[7]["flags"], out[9]["flags"], out[10]["flags"]) == (33, 2, 3)  # 32: there are rank offsets
    assert out[7]["rank_offsets"] == [0, 2, 5, 6] and out[9]["rank_offsets"] == out[10]["rank_offsets"] == []
    assert out[10]["edges"] == [] and out[10]["seq"] == "" and out[10]["contig_id"] == -1 and out[10]["range_id"] == 3
    block_rows.write(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert block_rows.read(spark, str(tmp_path / "none")).count() == 0


def test_bubbles_have_two_ways(spark):
    e = {tuple(r) for r in synthetic.edges(spark, 2, 10, bubble=4, cycles=0, cross=0).collect()}
    own = {(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 8), (8, 9), (9, 10)}
    assert e == own | {(a + 10, b + 10) for a, b in own}  # at 8 there is no room for another


@pytest.mark.parametrize("name", ["block_rows", "synthetic_edges", "synthetic_sequences"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, SF).select(*(F.col(c) for c in columns))
    assert rows and rows == sorted(map(tuple, got.collect()))
