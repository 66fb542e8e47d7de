import random

import pytest

from strandmap.operators import graph, ordered
from strandmap.sources import gfa


def pointed(targets):
    return [n for n in targets if not any(n in own for own in targets.values())]


def test_traversal_covers_each_node_once():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 30)
        targets = {i: sorted(rng.sample(range(1, n + 3), rng.randint(0, 3)) if n > 1 else []) for i in range(1, n + 1)}
        rows = list(graph.traverse(targets, pointed(targets), 1, n))
        assert sorted(r[0] for r in rows) == sorted(targets)
        blocks = [r[1] for r in rows]
        assert blocks == sorted(blocks)
        for (a, x, _, end), (b, y, start, _) in zip(rows, rows[1:]):
            assert (x == y) == (not end) == (not start)
            if x == y:  # a block goes on along the only way out
                assert targets[a] == [b]
    order = lambda t, starts: [r[0] for r in graph.traverse(t, starts, 1, max(t))]
    assert order({1: [2], 2: [3], 3: [], 4: [4]}, [1]) == [1, 2, 3, 4]
    assert order({1: [3], 2: [3], 3: []}, [1, 2]) == [2, 3, 1]
    assert order({1: [2], 2: [], 3: []}, [1]) == [1, 2, 3]  # 3 is entered from another range: it waits


def test_unitigs_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (6, 7), (7, 8), (8, 6), (9, 9)], "from_node bigint, to_node bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node_id bigint")
    got = {r.node_id: (r.block_id, r.ord) for r in graph.unitigs(edges, nodes).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (6, 1), 8: (6, 2), 9: (9, 0), 10: (10, 0)}
    comp = {r.node_id: r.component for r in graph.components(edges, nodes).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 6, 9: 9, 10: 10}


def test_ordered_scans(spark):
    keys = [3, 10, 11, 50, 51, 52, 400]
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k bigint, v bigint")
    from pyspark.sql import functions as F

    run = {r.k: r.s for r in ordered.running_sum(df, "k", F.col("v"), "s", width=10).collect()}
    total = 0
    for k in keys:
        total += k % 7
        assert run[k] == total
    before = {r.k: r.b for r in ordered.neighbour(df, "k", "b", width=10).collect()}
    assert before == dict(zip(keys, [None, *keys]))
    starts = spark.createDataFrame([(10,), (52,)], "s bigint")
    got = {r.k: r.g for r in ordered.as_of(df.select("k"), starts, "k", "s", "g", width=10).collect()}
    assert got == {3: None, 10: 10, 11: 10, 50: 10, 51: 10, 52: 52, 400: 52}


def test_gfa(spark, tmp_path):
    p = tmp_path / "a.gfa"
    p.write_text("H\tVN:Z:1.0\nS\t1\tACGT\tSN:Z:chr1\tXX:Z:a:b\n\nS\t2\tGG\nL\t1\t+\t2\t-\t0M\tSR:i:3\tSR:i:4\nW\ts\t1\tchr1\t0\t6\t>1<2\n")
    rows = gfa.lines(spark, str(p))
    seg = {r.id: r for r in gfa.segments(rows).collect()}
    assert seg["1"].sequence == "ACGT" and seg["1"].tags == {"SN": "chr1", "XX": "a:b"} and seg["2"].tags == {}
    link = gfa.links(rows).first()
    assert (link.from_id, link.from_fwd, link.to_id, link.to_fwd, link.tags) == ("1", True, "2", False, {"SR": "4"})
    assert [(r.step, r.id, r.forward) for r in gfa.walks(rows).orderBy("step").collect()] == [(0, "1", True), (1, "2", False)]


def test_oracles(spark):
    """Every query against its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from strandmap.plans import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    flat = lambda row: str([round(x, 9) if isinstance(x, float) else x for x in row])
    for name, f in catalog.QUERIES.items():
        df = f(spark, d)
        cols = sorted(df.columns)
        got = sorted(map(flat, df.select(*cols).collect()))
        if name in catalog.ORACLES:
            r = c.sql(catalog.ORACLES[name])
            assert sorted(r.columns) == cols, name
            assert got == sorted(map(flat, r.project(",".join(f'"{x}"' for x in cols)).fetchall())), name
        else:
            assert got, name


def test_ordered_scans_keep_null_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 6), (None, 5), (2, 1), (None, 7), (9000, 2)], "k bigint, v bigint").repartition(3)
    rows = lambda out: sorted(((r.k, r.v, r.x) for r in out.collect()), key=str)
    want = lambda *x: sorted([(1, 6, x[0]), (2, 1, x[1]), (9000, 2, x[2]), (None, 5, None), (None, 7, None)], key=str)
    assert rows(ordered.running_sum(df, "k", F.col("v"), "x")) == want(6, 7, 9)
    assert rows(ordered.number(df, "k", "x")) == want(0, 1, 2)
    assert rows(ordered.neighbour(df, "k", "x")) == want(None, 1, 2)
    assert rows(ordered.neighbour(df, "k", "x", after=True)) == want(2, 9000, None)
    starts = spark.createDataFrame([(2,), (None,)], "s bigint")
    assert rows(ordered.as_of(df, starts, "k", "s", "x")) == want(None, 2, 2)


def test_matches_and_sets(spark):
    labels = spark.createDataFrame([(1, "AC"), (2, "GT"), (3, "GG"), (4, "TTA"), (5, "A")], "node_id bigint, seq string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 5)], "from_node bigint, to_node bigint")
    patterns = spark.createDataFrame([(1, "ACGTTT"), (2, "ACGGTTAACG"), (3, "GTT"), (4, "CC"), (5, "AAAA")], "pattern_id bigint, pattern string")
    found = sorted(tuple(r) for r in graph.extend(patterns, labels, edges, 1, 3).collect())
    assert found == [(1, 1, 4, 3), (2, 1, 2, 5), (2, 1, 3, 5), (3, 2, 4, 2), (5, 5, 5, 4)]
    rng = random.Random(3)
    sets = {k: {rng.randint(0, 30) for _ in range(rng.randint(1, 8))} for k in range(80)}
    rows = spark.createDataFrame([(k, i) for k, own in sets.items() for i in own], "key bigint, item bigint")
    from strandmap.operators import walks

    for t in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in walks.similar(rows, t).collect()} == want


def test_packed_columns(spark):
    from pyspark.sql import functions as F

    from strandmap.functions import bits, dna

    rng = random.Random(7)
    for width in (1, 5, 19, 32):
        values = [[rng.getrandbits(width) for _ in range(n)] for n in (0, 1, 3, 64, 100)]
        df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
        for r in df.select("v", bits.pack_ints(F.col("v"), width).alias("w")).collect():
            whole = sum(x << width * i for i, x in enumerate(r.v))
            assert [x % (1 << 64) for x in r.w] == [whole >> 64 * k & (1 << 64) - 1 for k in range(-(-len(r.v) * width // 64))]
    s = F.col("s")
    good = spark.createDataFrame([("ACGTN",), ("acgtnACGTNa",), ("",), ("N" * 30,)], "s string")
    assert [r.b for r in good.select(dna.unpack(dna.pack(s, 3), F.length(s), 3).alias("b")).collect()] == ["ACGTN", "ACGTNACGTNA", "", "N" * 30]
    assert dna.format_bits(good, "s") == 3 and dna.format_bits(good.where("s = ''"), "s") == 2
    for text, width in (("ACGNT", 2), ("ACXT", 3), ("ACGT\n", 2), ("AC-", 3)):
        with pytest.raises(Exception, match="not a base"):
            spark.createDataFrame([(text,)], "s string").select(dna.pack(s, width)).collect()
    assert spark.createDataFrame([(None,)], "s string").select(dna.pack(s)).first()[0] is None
    parts = spark.createDataFrame([("ACG", "TTT")], "a string, b string").select(dna.pack(F.concat("a", "b"), flags=False).alias("w"), dna.unpack(dna.pack(F.concat("a", "b"), flags=False), F.lit(6)).alias("s")).first()
    assert parts.s == "ACGTTT" and all(x >= 0 for x in parts.w)


def test_ordered_scans_in_blocks_of_ranges(spark):
    """Many ranges and many blocks of ranges, with gaps between them."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    keys = sorted(rng.sample(range(-500, 4000), 300))
    rows = {k: rng.randint(-5, 9) for k in keys}
    df = spark.createDataFrame(list(rows.items()), "k bigint, v bigint")
    total, sums = 0, {}
    for k in keys:
        total += rows[k]
        sums[k] = total
    for width in (3, 7):
        assert {r.k: r.x for r in ordered.running_sum(df, "k", F.col("v"), "x", width).collect()} == sums
        assert {r.k: r.x for r in ordered.neighbour(df, "k", "x", width=width).collect()} == dict(zip(keys, [None, *keys]))
        assert {r.k: r.x for r in ordered.neighbour(df, "k", "x", after=True, width=width).collect()} == dict(zip(keys, [*keys[1:], None]))
        starts = [k for k in keys if k % 11 == 0]
        got = ordered.as_of(df, spark.createDataFrame([(s,) for s in starts], "s bigint"), "k", "s", "x", width)
        assert {r.k: r.x for r in got.collect()} == {k: max((s for s in starts if s <= k), default=None) for k in keys}


def test_packed_keys_of_any_size(spark, tmp_path):
    """Order keys of more than 19 bits, beside smaller ones of the same customer and alone."""
    from strandmap.plans import blocks

    keys = {1: [5, 524287, 524288, 9_000_000, 2**40 + 7, 2**62], 2: [0, 1, 524287], 3: [-1, 600_000], 4: [2**31] * 9}
    spark.createDataFrame([(c, k) for c, own in keys.items() for k in own], "o_custkey bigint, o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in blocks.packed_ints(spark, str(tmp_path)).collect())
    assert got == [(c, -(-len(own) * 19 // 64), i, k) for c, own in keys.items() for i, k in enumerate(sorted(own))]
