"""GFA text to the container and to block rows, against plain Python."""

import random

import pytest

from strandmap.operators import graph, walks
from strandmap.sources import block_rows, container, gfa


def slow_traverse(targets, starts, first, last):
    """Blocks of a range by the nine rules, with explicit state; (node, block, starts, ends)."""
    out, stack, seen, block, begun, inside = [], [(n, True) for n in sorted(starts)], set(), -1, False, 0
    while True:
        if not stack:
            if inside:
                begun, inside = False, 0
            left = [n for n in range(first, last + 1) if n not in seen]
            if not left:
                return out
            stack.append((left[0], True))
        node, flagged = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        if node not in targets:
            continue
        start = not begun or flagged
        if start:
            block, begun, inside = block + 1, True, 0
        inside += 1
        own = targets[node]
        within = [first <= t <= last and t not in seen for t in own]
        end = len(own) != 1 or not within[0]
        out.append((node, block, start, end))
        if len(own) == 1:
            stack += [(own[0], end)] if within[0] else []
        else:
            stack += [(t, True) for t, ok in reversed(list(zip(own, within))) if ok]
        if end:
            begun, inside = False, 0


def test_traversal_rules():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 25)
        first, last = rng.randint(1, 5), n + rng.randint(0, 3)
        targets = {i: [rng.randint(0, n + 4) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] for i in range(first, last + 1) if rng.random() < 0.9}
        starts = [i for i in targets if rng.random() < 0.2]
        assert list(graph.traverse(targets, starts, first, last)) == slow_traverse(targets, starts, first, last)


def test_tiling(spark):
    ends = spark.createDataFrame([(n,) for n in (5, 7, 7, 30, 31, 60, 0)], "node_id bigint")
    rows = [tuple(r) for r in graph.tiling(ends, 70, least=10).orderBy("range_id").collect()]
    assert rows == [(0, "ctg_00000", 1, 7), (1, "ctg_00001", 8, 31), (2, "ctg_00002", 32, 70)]
    assert [tuple(r)[2:] for r in graph.tiling(ends, 7, least=1).orderBy("range_id").collect()] == [(1, 5), (6, 7)]
    assert [tuple(r)[2:] for r in graph.tiling(ends.limit(0), 9).collect()] == [(1, 9)]
    assert graph.tiling(ends, 0).count() == 0
    assert [r.end_node for r in graph.longest_first(graph.tiling(ends, 70, least=10)).collect()] == [70, 31, 7]


GFA = """H\tVN:Z:1.0
S\ta\tACGT\tSN:Z:chr9
S\tb\tNN
S\tc\tGG
S\td\tT
S\te\tCCCCCCCCCCCCCCCCCC
S\tlonely\tA
L\ta\t+\tb\t+\t0M\tSR:i:5
L\tb\t+\tc\t+\t0M\tSR:i:5
L\tc\t+\td\t+\t0M\tSR:i:5
L\ta\t+\tc\t+\t0M\tSR:i:2
L\tc\t+\te\t-\t0M\tSR:i:2
L\te\t-\td\t+\t0M\tSR:i:2
L\ta\t+\tb\t+\t0M
L\tb\t+\ta\t+\t0M
L\tb\t+\tnowhere\t+\t0M\tSR:i:7
"""


def slow_records(paths):
    """Records of walks by sorting whole reversed prefixes; 0 is before the first and after the last node."""
    visits, begins = {}, []
    for p, path in enumerate(paths):
        begins.append(path[0])
        for i, n in enumerate(path):
            visits.setdefault(n, []).append((path[:i][::-1], p, path[i + 1] if i + 1 < len(path) else 0, path[i - 1] if i else 0))
    out = {}
    for n, own in [*visits.items(), (0, [([], p, b, 0) for p, b in enumerate(begins)])]:
        own.sort()
        targets = sorted({t for _, _, t, _ in own})
        runs = []
        for _, _, t, _ in own:
            k = targets.index(t)
            if runs and runs[-1][0] == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
        offsets = [sum(before < n for _, _, _, before in visits[t]) - (0 if n else sum(before < n for _, _, _, before in visits[t])) if t else 0 for t in targets]
        out[n] = ([(t, o) for t, o in zip(targets, offsets)], [tuple(r) for r in runs])
    return out


def test_records_of_random_walks(spark):
    rng = random.Random(8)
    paths = [[rng.randint(1, 6) for _ in range(rng.randint(1, 20))] for _ in range(15)]
    df = spark.createDataFrame([(p, i + 1, n) for p, path in enumerate(paths) for i, n in enumerate(path)], "path_id bigint, step bigint, node_id bigint")
    got = {r.node_id: ([tuple(x) for x in r.outgoing], [tuple(x) for x in r.runs]) for r in walks.records(df).collect()}
    assert got == slow_records(paths)
    at = {(r.path_id, r.step): r for r in walks.lf_positions(df).collect()}
    for (p, s), r in at.items():  # a step leads to the visit's own position in the next node
        if (p, s + 1) in at:
            assert r.next_position == at[p, s + 1].position


@pytest.mark.parametrize("zstd", [True, False])
def test_gfa_to_container(spark, tmp_path, zstd):
    (tmp_path / "g.gfa").write_text(GFA)
    g = gfa.Graph(spark, str(tmp_path / "g.gfa"))
    found = {}
    for r in g.walks.orderBy("walk", "step").collect():
        found.setdefault(r.walk, []).append(r.node_id)
    assert found == {5: [2, 4, 6, 8], 2: [2, 6, 11, 8]}  # walk 0 is a circle: it has no start
    path = str(tmp_path / "g.bin")
    g.write_container(path, zstd)
    m = container.load(spark, path)
    assert [r.seq for r in m["sequences"].orderBy("node_id").collect()] == ["ACGT", "NN", "GG", "T", "C" * 18, "A"]
    assert [tuple(r) for r in m["segments"].orderBy("segment_id").collect()] == [(i, n, i + 1) for i, n in enumerate(["a", "b", "c", "d", "e", "lonely"])]
    assert [tuple(r) for r in m["paths"].orderBy("path_id").collect()] == [(i, 0, 0, p, 0) for i, p in enumerate([0, 2, 5])]
    assert [r.name for r in m["contigs"].collect()] == ["chr9"] and [r.name for r in m["samples"].collect()] == ["GFA_SAMPLE"]
    want = slow_records([[2, 6, 11, 8], [9, 10, 7, 3], [2, 4, 6, 8], [9, 7, 5, 3]])
    got = {(r.record_id + 1 if r.record_id else 0): ([tuple(x) for x in r.outgoing], [tuple(x) for x in r.runs]) for r in m["records"].collect()}
    assert sorted(got) == [0, *range(2, 14)]
    for t, (outgoing, runs) in want.items():
        if t not in (4, 3):  # these have an edge of a link that no walk takes
            assert got[t] == (outgoing, runs)
    assert got[4] == ([(2, 2), (6, 1)], [(1, 1)]) and got[12] == got[13] == ([], [])
    p = {r.module: r for r in container.predicates(m["headers"]).collect()}
    assert p["index"].simple and p["index"].metadata and p["index"].bidirectional and p["graph"].translation and p["graph"].zstd == zstd
    assert container.described(m["headers"]).where("module = 'graph'").first().text == f"graph v{4 if zstd else 3}, nodes=6"
    assert tuple(container.broken(spark, path).first()) == (13, 0)
    assert container.label(spark, path, 3) == "GG" and container.label(spark, path, 99) is None and container.label(spark, path, 0) is None
    assert container.edge_count(m["records"], 1).first()[0] == 2 and container.edge_target(m["records"], 1, 1).first()[0] == 6
    assert container.edge_target(m["records"], 1, 9).count() == 0
    assert [s for s, _ in container.stages(path)] == ["container_tags", "index_tags", "records", "paths", "sequences", "segments"]
    raw = open(path, "rb").read()
    assert b"".join(bytes(r.data) for r in container.chunks(spark, path, 100).orderBy("chunk").collect()) == raw
    packed = container.read(spark, path, "packed")
    if zstd:
        with pytest.raises(Exception, match="packed form"):
            packed.collect()
    else:
        from pyspark.sql import functions as F

        from strandmap.functions import dna

        back = packed.select("node_id", "bits", dna.unpack(F.col("words"), F.col("length"), 3).alias("seq")).orderBy("node_id").collect()
        assert [r.seq for r in back] == ["ACGT", "NN", "GG", "T", "C" * 18, "A"] and {r.bits for r in back} == {3}
        again = container.read(spark, path, "sequences").select("node_id", dna.pack(F.col("seq"), 3).alias("words"))
        assert {r.node_id: r.words for r in again.collect()} == {r.node_id: r.words for r in packed.collect()}


def test_gfa_to_block_rows(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA)
    g = gfa.Graph(spark, str(tmp_path / "g.gfa"))
    g.write_block_rows(str(tmp_path / "rows"))
    out = block_rows.read(spark, str(tmp_path / "rows")).orderBy("range_id", "ord").collect()
    targets = {1: [2, 3], 2: [1, 3], 3: [4, 5], 4: [], 5: [], 6: []}
    order = slow_traverse(targets, [6], 1, 6)
    assert [(r.node_id, bool(r["flags"] & 1), bool(r["flags"] & 2)) for r in out] == [(n, s, e) for n, _, s, e in order]
    rows = {r.node_id: r for r in out}
    assert rows[3].edges == [4, 5] and rows[3].edge_orientations == [2, 3] and rows[3].edge_support == [1, 1]
    assert rows[1].rank_offsets == [0, 1, 2] and rows[1]["flags"] & 32 and rows[1].edge_support == [1, 1]
    assert rows[2].seq == "NN" and rows[5].seq == "C" * 18 and rows[2].edge_support == [0, 1]


def test_old_containers(spark, tmp_path):
    """Optional blocks, and the graph header, may be left out: the next part's word is no size then."""
    c = container
    data = c.codec.encode_record([(2, 0)], [(0, 1)])
    head = c.words(c.CONTAINER_TAG | 1 << 32, 0) + c.tags_bytes({})
    index = c.words(c.INDEX_TAG | 5 << 32, 1, 1, 1, 3, c.INDEX_SIMPLE) + c.tags_bytes({}) + c.sparse_bytes([0]) + c.blob(data)
    labels = c.strings_bytes(["ACGT", "G"]) + c.strings_bytes([]) + c.sparse_bytes([])
    # no samples, no metadata, no graph header: labels begin with their universe, which is larger than the file
    big = c.strings_bytes(["A" * 40000, "G"]) + c.strings_bytes([]) + c.sparse_bytes([])
    (tmp_path / "none").write_bytes(head + index + big)
    parts = c.layout(c.Words(str(tmp_path / "none")))
    assert parts["graph"] == {"version": 3, "nodes": 2, "flags": 0} and "da" not in parts and "metadata" not in parts
    assert [r.seq for r in c.read(spark, str(tmp_path / "none"), "sequences").orderBy("node_id").collect()] == ["A" * 40000, "G"]
    (tmp_path / "empty").write_bytes(head + index + c.words(0, 0) + labels)
    assert c.layout(c.Words(str(tmp_path / "empty")))["graph"]["nodes"] == 2
    da = c.bits_bytes([1, 3], 5) + c.sparse_bytes([0, 4]) + c.sparse_bytes([1, 2, 9]) + c.ints_bytes([3, 0, 2], 2)
    (tmp_path / "da").write_bytes(head + index + c.words(len(da) // 8) + da + c.words(0) + c.words(c.GRAPH_TAG | 3 << 32, 2, 0) + labels)
    rows = {}
    for r in c.read(spark, str(tmp_path / "da"), "da_samples").orderBy("part", "idx").collect():
        rows.setdefault(r.part, []).append(r.value)
    assert rows == {"marked": [1, 3], "ranges": [0, 4], "offsets": [1, 2, 9], "array": [3, 0, 2]}
    flagged = c.words(c.INDEX_TAG | 5 << 32, 1, 1, 1, 3, c.INDEX_SIMPLE | c.INDEX_METADATA) + c.tags_bytes({}) + c.sparse_bytes([0]) + c.blob(data)
    (tmp_path / "bad").write_bytes(head + flagged + c.words(0, 0) + labels)
    with pytest.raises(ValueError):
        c.layout(c.Words(str(tmp_path / "bad")))
    broken = c.words(c.INDEX_TAG | 5 << 32, 1, 1, 1, 3, c.INDEX_SIMPLE) + c.tags_bytes({}) + c.sparse_bytes([0, len(data)]) + c.blob(data + b"\x05\x80")
    (tmp_path / "cut").write_bytes(head + broken + c.words(0, 0) + labels)
    assert tuple(c.broken(spark, str(tmp_path / "cut")).first()) == (2, 1)
