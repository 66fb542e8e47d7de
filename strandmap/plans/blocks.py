"""Queries of the traversal, of ranges, runs by node, packed columns and matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits, dna
from ..operators import graph, walks
from ..sources import block_rows as rows_sink
from ..sources import gfa, synthetic
from . import tables as t
from .registry import ORACLES, query
from .tables import SEQ, STEPS, SUPPORT, W1, W2, W4

# Ranges and traversal

WIDTH = 500

#: The traversal's state by range: nodes seen, the stack, whether a block is open. A step drops what was seen from
#: the stack, takes its top or else the smallest node left, and puts the node's ways on it.
DFS = f"""
    WITH RECURSIVE {W1}, {STEPS}, {SUPPORT}, n AS (SELECT DISTINCT node_id, node_id // {WIDTH} AS range_id FROM w),
    o AS (SELECT from_node, list(to_node ORDER BY to_node) AS own FROM e GROUP BY 1),
    z AS (SELECT node_id FROM n WHERE node_id NOT IN (SELECT to_node FROM e)),
    a AS (SELECT n.*, coalesce(own, []) AS own, node_id - range_id * {WIDTH} AS place FROM n LEFT JOIN o ON from_node = node_id),
    i AS (SELECT range_id, list({{'n': n.node_id, 'f': true}} ORDER BY n.node_id) FILTER (z.node_id IS NOT NULL) AS starts, list(n.node_id - range_id * {WIDTH}) AS present FROM n LEFT JOIN z ON z.node_id = n.node_id GROUP BY 1),
    d AS (
        SELECT range_id, CAST(array_to_string(list_transform(range(0, {WIDTH}), lambda p: CASE WHEN list_contains(present, p) THEN '0' ELSE '1' END), '') AS BIT) AS seen,
            coalesce(starts, []) AS stack, false AS going, -1::BIGINT AS block_id, -1::BIGINT AS ord, NULL::BIGINT AS node_id, NULL::BOOLEAN AS is_start, NULL::BOOLEAN AS is_end FROM i
        UNION ALL
        SELECT range_id, seen2, list_concat(rest, list_transform(list_reverse(list_filter(own, lambda x: x // {WIDTH} = range_id AND get_bit(seen2, CAST(x % {WIDTH} AS INTEGER)) = 0)), lambda x: {{'n': x, 'f': is_end2}})),
            NOT is_end2, block_id + CAST(is_start2 AS BIGINT), ord + 1, node, is_start2, is_end2
        FROM (
            SELECT *, len(own) <> 1 OR own[1] // {WIDTH} <> range_id OR get_bit(seen2, CAST(own[1] % {WIDTH} AS INTEGER)) = 1 AS is_end2 FROM (
                SELECT g.*, a.own, set_bit(seen, CAST(a.place AS INTEGER), 1) AS seen2, fresh OR NOT going2 AS is_start2 FROM (
                    SELECT range_id, seen, block_id, ord, len(live) > 0 AND going AS going2, CASE WHEN len(live) > 0 THEN live[-1].n ELSE range_id * {WIDTH} + bit_position('0'::BIT, seen) - 1 END AS node,
                        len(live) = 0 OR live[-1].f AS fresh, live[1:len(live) - 1] AS rest
                    FROM (SELECT *, list_filter(stack, lambda x: get_bit(seen, CAST(x.n % {WIDTH} AS INTEGER)) = 0) AS live FROM d WHERE bit_count(seen) < {WIDTH})
                ) g JOIN a ON a.node_id = node
            )
        )
    )
    SELECT range_id, ord, node_id, block_id, is_start, is_end FROM d WHERE node_id IS NOT NULL
"""


@query(DFS)
def blocks_dfs(spark, d):
    """Ordered traversal of the part graph, cut into ranges of 500 nodes; sources by the edges of the whole graph."""
    w = t.part_walks(spark, d)
    e = walks.support(w)
    out = e.groupBy(F.col("from_node").alias("node_id")).agg(F.array_sort(F.collect_list("to_node")).alias("targets"))
    source = graph.sources(walks.nodes(w), e).withColumn("source", F.lit(True))
    rows = walks.nodes(w).join(out, "node_id", "left").join(source, "node_id", "left").withColumn("range_id", F.expr(f"node_id div {WIDTH}"))
    bounds = [(F.col("range_id") * WIDTH).alias("start_node"), (F.col("range_id") * WIDTH + WIDTH - 1).alias("end_node")]
    return graph.dfs_blocks(rows.select("range_id", *bounds, "node_id", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"), F.coalesce("source", F.lit(False)).alias("source")))


RANGES = f"""{W4}, n AS (SELECT max(o_orderkey) AS n FROM orders), p AS (SELECT DISTINCT max_by(node_id, step) AS node FROM w WHERE path_id % 50 = 0 GROUP BY path_id),
    g AS (SELECT node, lead(node) OVER (ORDER BY node) - node AS gap FROM p WHERE node >= 1),
    c AS (SELECT node AS end_node FROM g, n WHERE gap > greatest(1000, n // 500) AND node < n UNION ALL SELECT n FROM n),
    r AS (SELECT row_number() OVER (ORDER BY end_node) - 1 AS range_id, lag(end_node, 1, 0) OVER (ORDER BY end_node) + 1 AS start_node, end_node FROM c)"""


@query(f"WITH {RANGES} SELECT range_id, 'ctg_' || lpad(CAST(range_id AS VARCHAR), 5, '0') AS name, start_node, end_node FROM r")
def contig_ranges(spark, d):
    """Ranges that tile all nodes, cut at wide gaps between the ends of some walks."""
    ends = t.order_walks(spark, d).where("path_id % 50 = 0").groupBy("path_id").agg(F.max_by("node_id", "step").alias("node_id"))
    return graph.tiling(ends, t.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0])


@query(f"WITH {RANGES}, s AS (SELECT *, end_node - start_node + 1 AS size FROM r) SELECT range_id, size, row_number() OVER (ORDER BY size DESC, start_node) AS place FROM s")
def ranges_longest_first(spark, d):
    rows = graph.longest_first(contig_ranges(spark, d)).select("range_id", "size").collect()  # a row a range
    return spark.createDataFrame([(r.range_id, r.size, i) for i, r in enumerate(rows, 1)], "range_id bigint, size bigint, place bigint")


@query(f"WITH {W4} SELECT node_id, count(*) OVER (PARTITION BY path_id) AS size, row_number() OVER (PARTITION BY path_id ORDER BY step) AS place FROM w WHERE node_id BETWEEN 100 AND 4000")
def block_bounds(spark, d):
    """Chains of the nodes within bounds, by edges whose targets lie there."""
    w = t.order_walks(spark, d).where("node_id between 100 and 4000")
    rows = graph.unitigs(graph.in_bounds(walks.support(w), 4000), walks.nodes(w))
    size = rows.groupBy("block_id").agg(F.count("*").alias("size"))
    return rows.join(size, "block_id").select("node_id", "size", (F.col("ord") + 1).alias("place"))


# Runs and ranks by node

CHOICES = f"""{W1}, {STEPS}, f AS (SELECT from_node, to_node, row_number() OVER (PARTITION BY from_node ORDER BY min((path_id, step))) - 1 AS outrank FROM s GROUP BY from_node, to_node),
    v AS (SELECT s.from_node AS node_id, outrank, row_number() OVER (PARTITION BY s.from_node ORDER BY path_id, step) AS pos, row_number() OVER (PARTITION BY s.from_node, outrank ORDER BY path_id, step) AS k FROM s JOIN f USING (from_node, to_node)),
    r AS (SELECT node_id, outrank, min(pos) AS first, count(*) AS len FROM v GROUP BY node_id, outrank, pos - k)"""


@query(f"WITH {CHOICES} SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY first) AS run, outrank, len FROM r")
def choice_rle(spark, d):
    return walks.choice_runs(t.part_walks(spark, d))


@query(
    f"""WITH {CHOICES}, o AS (SELECT *, sum(len) OVER (PARTITION BY node_id ORDER BY first) AS upto FROM r)
    SELECT node_id, '0,' || string_agg(CAST(upto AS BIGINT), ',' ORDER BY first) AS rank_offsets, CAST(sum(len) AS BIGINT) AS paths, CAST(sum(len) FILTER (outrank = 0) AS BIGINT) AS first_edge, 32 AS flags FROM o GROUP BY 1"""
)
def node_ranks(spark, d):
    """Running sums of each node's runs, its paths, those by its first edge, and the flag that it has ranks."""
    rows = walks.choice_runs(t.part_walks(spark, d)).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("run", "outrank", "len"))).alias("r"))
    sums = F.aggregate("r", F.array(F.lit(0).cast("bigint")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["len"])))
    rows = rows.select("node_id", sums.alias("o"), F.transform("r", lambda x: x["outrank"]).alias("edges"))
    flags = F.when(F.size("o") > 0, bits.HAS_RANKS).otherwise(0)
    return rows.select("node_id", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("rank_offsets"), F.element_at("o", -1).alias("paths"), rows_sink.paths_of_edge(F.col("o"), F.col("edges"), F.lit(0)).alias("first_edge"), flags.alias("flags"))


@query(f"WITH {W1} SELECT node_id, string_agg(path_id || ':' || step, ',' ORDER BY path_id, step) AS visits FROM w GROUP BY 1")
def node_visits(spark, d):
    rows = walks.node_visits(t.part_walks(spark, d))
    return rows.select("node_id", F.array_join(F.transform("visits", lambda v: F.concat(v["path_id"].cast("string"), F.lit(":"), v["step"].cast("string"))), ",").alias("visits"))


@query(f"WITH {W1} SELECT path_id, dense_rank() OVER (ORDER BY path_id) - 1 AS number FROM w GROUP BY path_id")
def walk_numbers(spark, d):
    return walks.walk_numbers(t.part_walks(spark, d))


@query(
    f"""WITH RECURSIVE {W1}, {STEPS}, j AS (SELECT path_id, from_node, max_by(to_node, step) AS to_node FROM s GROUP BY ALL),
    b AS (SELECT path_id, min(from_node) AS node_id FROM j WHERE NOT EXISTS (SELECT 1 FROM j x WHERE x.path_id = j.path_id AND x.to_node = j.from_node) GROUP BY 1),
    r AS (SELECT path_id, 1::BIGINT AS step, node_id, [node_id] AS seen FROM b UNION ALL SELECT r.path_id, step + 1, to_node, list_append(seen, to_node) FROM r JOIN j ON j.path_id = r.path_id AND from_node = node_id WHERE NOT list_contains(seen, to_node))
    SELECT path_id AS walk, step, node_id FROM r"""
)
def links_traced(spark, d):
    """Walks found again from their links, of which the last from a node counts."""
    links = walks.steps(t.part_walks(spark, d)).select(F.col("path_id").alias("walk"), F.col("step").alias("line_no"), "from_node", "to_node")
    return walks.traced(links)


@query(f"WITH {W1}, {STEPS}, j AS (SELECT path_id, from_node, max_by(to_node, step) AS to_node FROM s GROUP BY ALL) SELECT path_id, min(from_node) AS start_node FROM j WHERE NOT EXISTS (SELECT 1 FROM j x WHERE x.path_id = j.path_id AND x.to_node = j.from_node) GROUP BY 1")
def walk_starts(spark, d):
    return links_traced(spark, d).where("step = 1").select(F.col("walk").alias("path_id"), F.col("node_id").alias("start_node"))


# Sites, clusters, matches


@query(
    f"""WITH {W2}, m AS (SELECT path_id, step, node_id, lag(node_id) OVER x AS last, lag(step) OVER x AS first FROM w WHERE node_id IN ('view', 'purchase') WINDOW x AS (PARTITION BY path_id ORDER BY step)),
    s AS (SELECT path_id, first, step AS stop FROM m WHERE node_id = 'purchase' AND last = 'view')
    SELECT s.path_id, first AS step, coalesce(string_agg(node_id, '>' ORDER BY w.step), '') AS allele FROM s LEFT JOIN w ON w.path_id = s.path_id AND w.step > first AND w.step < stop GROUP BY s.path_id, first"""
)
def site_traversals(spark, d):
    """What each walk has between two boundary nodes."""
    return walks.between(t.event_walks(spark, d), "view", "purchase")


@query(
    """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.key AS a, b.key AS b, count(*) AS k FROM s a JOIN s b ON a.item = b.item AND a.key <> b.key GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.key = a JOIN n y ON y.key = b WHERE k / (x.n + y.n - k) >= 0.5),
    r AS (SELECT key, key AS low FROM n UNION SELECT b, low FROM r JOIN l ON a = key)
    SELECT key AS node_id, min(low) AS component FROM r GROUP BY 1"""
)
def walk_clusters(spark, d):
    """Orders joined by chains of orders that share half of their parts or more."""
    return walks.clusters(t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")).distinct(), 0.5)


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.key AS a, b.key AS b, count(*) AS k FROM s a JOIN s b ON a.item = b.item AND a.key < b.key GROUP BY ALL)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON x.key = a JOIN n y ON y.key = b WHERE k / (x.n + y.n - k) >= 0.5"""
)
def kmer_jaccard(spark, d):
    """All pairs of sets whose Jaccard similarity is a half or more."""
    sets = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")).distinct()
    return walks.similar(sets, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    f"""WITH RECURSIVE l AS ({ORACLES.get("synthetic_sequences", "")}), e AS ({ORACLES.get("synthetic_edges", "")}),
    p AS (SELECT a.node_id AS pattern_id, a.seq || b.seq || left(c.seq, 4) AS pattern FROM l a JOIN l b ON b.node_id = a.node_id + 1 JOIN l c ON c.node_id = a.node_id + 2 WHERE a.node_id % 7 = 1),
    r AS (
        SELECT pattern_id, pattern, l.node_id AS start_node, l.node_id, CAST(length(seq) AS BIGINT) AS used, 1::BIGINT AS nodes FROM p JOIN l ON left(pattern, 5) = left(seq, 5) AND starts_with(pattern, seq)
        UNION SELECT pattern_id, pattern, start_node, to_node, used + length(seq), nodes + 1 FROM r JOIN e ON from_node = r.node_id JOIN l ON l.node_id = to_node
        WHERE used < length(pattern) AND left(substr(pattern, used + 1), length(seq)) = left(seq, length(pattern) - used)
    ) SELECT pattern_id, start_node, node_id AS end_node, nodes FROM r WHERE used >= length(pattern)"""
    if "synthetic_edges" in ORACLES
    else None
)
def label_walks(spark, d):
    """Walks of the synthetic graph whose labels read a pattern."""
    labels, e = synthetic.sequences(spark, 60, 400).select("node_id", "seq"), synthetic.edges(spark, 60, 400)
    at = lambda k, name: labels.select((F.col("node_id") - k).alias("pattern_id"), F.col("seq").alias(name))
    patterns = at(0, "a").where("pattern_id % 7 = 1").join(at(1, "b"), "pattern_id").join(at(2, "c"), "pattern_id").select("pattern_id", F.concat("a", "b", F.substring("c", 1, 4)).alias("pattern"))
    return graph.extend(patterns, labels, e, synthetic.SHORTEST, synthetic.SHORTEST + synthetic.LENGTHS - 1)


@query(
    f"""WITH {W4}, x AS (SELECT path_id, node_id, step, (step - 1) // 3 AS b FROM w), g AS (SELECT path_id, b, min_by(node_id, step) AS block_id, string_agg(node_id, ',' ORDER BY step) AS nodes FROM x GROUP BY ALL)
    SELECT block_id, nodes, coalesce(CAST(lead(block_id) OVER (PARTITION BY path_id ORDER BY b) AS VARCHAR), '') AS children FROM g"""
)
def block_flatten(spark, d):
    """Blocks of three nodes along the order chains: their nodes and the blocks they lead to."""
    w = t.order_walks(spark, d)
    b = w.select("node_id", "path_id", F.expr("(step - 1) div 3").alias("b"), "step")
    first = b.groupBy("path_id", "b").agg(F.min_by("node_id", "step").alias("block_id"))
    rows = graph.flatten_blocks(b.join(first, ["path_id", "b"]).select("node_id", "block_id", F.col("step").alias("ord")), walks.support(w))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("block_id", joined("nodes").alias("nodes"), joined("children").alias("children"))


# Packed columns


@query("SELECT o_custkey, o_orderkey // 32768 AS bucket, count(DISTINCT o_orderkey) AS n, bool_or(o_orderkey % 32768 = 77) AS has FROM orders GROUP BY ALL")
def key_bitmaps(spark, d):
    """Bitmaps of each customer's order keys: set bits, and whether a certain one is."""
    k = F.col("o_orderkey") + 1  # bits are numbered from 1
    rows = t.table(spark, d, "orders").groupBy("o_custkey", (F.bitmap_bucket_number(k) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("map"))
    byte = F.conv(F.hex(F.expr(f"substring(map, {77 // 8 + 1}, 1)")), 16, 10).cast("int")
    return rows.select("o_custkey", "bucket", F.bitmap_count("map").alias("n"), (F.shiftright(byte, 77 % 8).bitwiseAND(1) == 1).alias("has"))


@query("SELECT o_orderkey, o_orderkey + CASE WHEN o_custkey % 2 = 0 THEN 2147483648 ELSE 0 END AS entry, o_orderkey AS node, o_custkey % 2 = 0 AS fresh, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END + CAST(o_orderkey % 2 AS INTEGER) AS orientation FROM orders")
def stack_entries(spark, d):
    fresh = F.col("o_custkey") % 2 == 0
    rows = t.table(spark, d, "orders").select("o_orderkey", bits.stack_entry(F.col("o_orderkey"), fresh).alias("entry"), bits.orientation(fresh.cast("int"), (F.col("o_orderkey") % 2).cast("int")).alias("orientation"))
    node, begins = bits.of_stack_entry(F.col("entry"))
    return rows.select("o_orderkey", "entry", node.alias("node"), begins.alias("fresh"), "orientation")


@query("WITH k AS (SELECT o_custkey, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, (n * 19 + 63) // 64 AS words, i, v FROM k")
def packed_ints(spark, d):
    """Each customer's order keys in 19 bits each, what passes these beside them, and every one read from both."""
    rows = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    words, above = bits.pack_split(F.col("v"), 19)
    rows = rows.select("o_custkey", F.size("v").alias("n"), words.alias("w"), above.alias("above"))
    rows = rows.select("o_custkey", "w", "above", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("o_custkey", F.size("w").cast("bigint").alias("words"), F.col("i").cast("bigint").alias("i"), bits.split_at(F.col("w"), F.col("above"), F.col("i"), 19).alias("v"))


#: Words of 10 bases at 3 bits; the last position of each document is read from them.
WORDS3 = f"""{SEQ}, b AS (SELECT doc_id, translate(seq, 'ACGTN', '01234') AS s FROM q), i AS (SELECT doc_id, s, unnest(range(0, (length(s) + 9) // 10)) AS k FROM b),
    p AS (SELECT doc_id, k, substr(s, CAST(10 * k + 1 AS BIGINT), 10) AS part FROM i)"""


@query(f"WITH {WORDS3} SELECT doc_id, k AS word_no, CAST(list_sum([CAST(part[j] AS BIGINT) * (1::BIGINT << CAST(3 * (j - 1) AS INTEGER)) for j in range(1, length(part) + 1)]) - CASE WHEN length(part) = 10 THEN 2147483648 ELSE 0 END AS INTEGER) AS word, length(part) = 10 AS is_full FROM p")
def dna_pack3(spark, d):
    """All labels, N included, at 3 bits a base."""
    rows = dna.packed(t.sequences(spark, d)).select("doc_id", F.posexplode("words").alias("k", "word"))
    return rows.select("doc_id", F.col("k").cast("bigint").alias("word_no"), "word", dna.is_full(F.col("word")).alias("is_full"))


@query(f"WITH {SEQ} SELECT doc_id, seq, CAST((length(seq) + 9) // 10 AS BIGINT) AS words, right(seq, 1) AS last_base, substr(seq, 11, 20) AS second_words FROM q")
def dna_unpack3(spark, d):
    """Labels read from their words: whole, their last base alone, and two words copied."""
    n, w = F.col("length"), F.col("words")
    last = F.when(n > 0, dna.base_at(w, n - 1, 3)).otherwise("")
    part = dna.unpack(dna.copy_words(w, F.lit(1), F.lit(2)), F.greatest(F.lit(0), F.least(F.lit(20), n - 10)), 3)
    return dna.packed(t.sequences(spark, d)).select("doc_id", dna.unpack(w, n, 3).alias("seq"), dna.words_for(n, 3).cast("bigint").alias("words"), last.alias("last_base"), part.alias("second_words"))


@query("SELECT event_id, upper(event_type) || ':' || value AS k, 'b:c' AS n, regexp_replace(props, '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM events")
def field_tags(spark, d):
    """Fields NAME:TYPE:VALUE: values keep further colons, of a repeated name the last counts, others are left out."""
    f = F.array(F.lit("K:Z:first"), F.lit("no tag"), F.concat(F.lit("K:Z:"), F.upper("event_type"), F.lit(":"), F.col("value").cast("string")), F.lit("N:i:b:c"))
    rows = t.table(spark, d, "events").select("event_id", gfa.tags(f).alias("m"), bits.safe_name(F.col("props")).alias("name"))
    return rows.select("event_id", F.col("m")["K"].alias("k"), F.col("m")["N"].alias("n"), "name")


