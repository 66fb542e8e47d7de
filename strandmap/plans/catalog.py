"""All registered queries of the graph engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, codec, dna
from ..operators import graph, ordered, walks
from ..operators.storage import new_path
from ..sources import block_rows as rows_sink
from ..sources import synthetic
from . import tables as t
from .registry import ORACLES, QUERIES, query
from .tables import SEGMENTS, SEQ, STEPS, SUPPORT, W1, W2, W3, W4

# Degrees, support, frequencies


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT from_node, to_node, support FROM e")
def edges_support(spark, d):
    return walks.support(t.part_walks(spark, d))


@query(f"WITH {W1}, {STEPS}, {SUPPORT}, i AS (SELECT to_node, count(*) AS n FROM e GROUP BY 1) SELECT DISTINCT node_id, CAST(least(coalesce(n, 0), 2) AS BIGINT) AS in_degree FROM w LEFT JOIN i ON to_node = node_id")
def in_degree_sat(spark, d):
    return walks.in_degree(t.part_walks(spark, d))


@query(f"WITH {W1}, {STEPS}, {SUPPORT}, o AS (SELECT from_node, count(*) AS n FROM e GROUP BY 1) SELECT DISTINCT node_id, CAST(coalesce(n, 0) AS BIGINT) AS out_degree FROM w LEFT JOIN o ON from_node = node_id")
def out_degree(spark, d):
    return walks.out_degree(t.part_walks(spark, d))


@query(f"WITH {W1}, {STEPS}, {SUPPORT}, i AS (SELECT to_node, count(*) AS n FROM e GROUP BY 1), n AS (SELECT DISTINCT node_id FROM w) SELECT count(*) AS nodes, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS sources, count(*) FILTER (WHERE n > 1) AS merges FROM n LEFT JOIN i ON to_node = node_id")
def degree_sets(spark, d):
    deg = walks.in_degree(t.part_walks(spark, d))
    return deg.agg(F.count("*").alias("nodes"), F.count_if(F.col("in_degree") == 0).alias("sources"), F.count_if(F.col("in_degree") > 1).alias("merges"))


@query(f"WITH {W4}, {STEPS} SELECT node_id FROM w WHERE node_id NOT IN (SELECT to_node FROM s)")
def zero_in_degree(spark, d):
    return walks.starts(t.order_walks(spark, d))


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT from_node, to_node, round(support / sum(support) OVER (PARTITION BY from_node), 6) AS frequency FROM e")
def edge_frequency(spark, d):
    return walks.frequency(t.part_walks(spark, d))


@query(f"WITH {W1} SELECT node_id, count(*) AS visits, count(DISTINCT path_id) AS paths FROM w GROUP BY 1")
def node_support(spark, d):
    return t.part_walks(spark, d).groupBy("node_id").agg(F.count("*").alias("visits"), F.countDistinct("path_id").alias("paths"))


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT to_node, string_agg(from_node, ',' ORDER BY from_node) AS sources, count(*) AS n FROM e GROUP BY 1")
def incoming_index(spark, d):
    return walks.support(t.part_walks(spark, d)).groupBy("to_node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("from_node")), lambda x: x.cast("string")), ",").alias("sources"), F.count("*").alias("n"))


@query(f"WITH {W1}, {STEPS} SELECT from_node, to_node, count(DISTINCT path_id) AS paths, min(path_id) AS first_path FROM s GROUP BY ALL")
def edge_paths(spark, d):
    return walks.steps(t.part_walks(spark, d)).groupBy("from_node", "to_node").agg(F.countDistinct("path_id").alias("paths"), F.min("path_id").alias("first_path"))


@query(f"WITH {W1}, {STEPS}, f AS (SELECT from_node, to_node, min((path_id, step)) AS k FROM s GROUP BY ALL) SELECT from_node, to_node, row_number() OVER (PARTITION BY from_node ORDER BY k) - 1 AS outrank FROM f")
def outrank(spark, d):
    return walks.outranks(t.part_walks(spark, d))


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT from_node, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, from_node LIMIT 20")
def topk_hubs(spark, d):
    return walks.support(t.part_walks(spark, d)).groupBy("from_node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "from_node").limit(20)


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT (SELECT count(*) FROM w) AS visits, (SELECT count(DISTINCT node_id) FROM w) AS nodes, (SELECT count(DISTINCT path_id) FROM w) AS paths, (SELECT count(*) FROM e) AS edges, (SELECT CAST(sum(support) AS BIGINT) FROM e) AS steps")
def graph_totals(spark, d):
    w = t.part_walks(spark, d)
    e = walks.support(w).agg(F.count("*").alias("edges"), F.sum("support").alias("steps"))
    return w.agg(F.count("*").alias("visits"), F.countDistinct("node_id").alias("nodes"), F.countDistinct("path_id").alias("paths")).join(F.broadcast(e), F.lit(True))  # one row each


@query(f"WITH {W1}, {STEPS}, {SUPPORT} SELECT x.from_node AS source, y.to_node AS sink, count(*) AS middles FROM e x JOIN e y ON x.to_node = y.from_node WHERE x.from_node <> x.to_node AND y.from_node <> y.to_node AND x.from_node <> y.to_node GROUP BY ALL HAVING count(*) >= 2")
def bubbles(spark, d):
    return walks.bubbles(t.part_walks(spark, d))


# Runs, ranks, order


RUNS = f"{W2}, i AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY step) - row_number() OVER (PARTITION BY path_id, node_id ORDER BY step) AS k FROM w), r AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY min(step)) AS run, node_id, count(*) AS len FROM i GROUP BY path_id, node_id, k)"


@query(f"WITH {RUNS} SELECT path_id, run, node_id, len FROM r")
def path_rle(spark, d):
    return walks.runs(t.event_walks(spark, d))


@query(f"WITH {RUNS} SELECT path_id, run, len, CAST(sum(len) OVER x - len AS BIGINT) AS rank_start, CAST(sum(len) OVER x AS BIGINT) AS rank_end FROM r WINDOW x AS (PARTITION BY path_id ORDER BY run)")
def rank_offsets(spark, d):
    return walks.rank_offsets(t.event_walks(spark, d))


@query(f"WITH {RUNS} SELECT path_id, CAST(sum(len) AS BIGINT) AS total, count(*) AS runs, string_agg(o, ',' ORDER BY run) AS offsets FROM (SELECT *, sum(len) OVER (PARTITION BY path_id ORDER BY run) AS o FROM r) GROUP BY 1")
def rank_offset_lists(spark, d):
    rows = walks.rank_offsets(t.event_walks(spark, d)).groupBy("path_id").agg(F.array_sort(F.collect_list("rank_end")).alias("o"))
    return rows.select("path_id", F.element_at("o", -1).alias("total"), F.size("o").cast("bigint").alias("runs"), F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("offsets"))


#: Bytes of a record whose edges lead to 0, 1, .. with rank offsets 0: numbers below 128 are a byte each.
BYTE = "printf('%02X', {})"
NUMBER = f"CASE WHEN {{0}} < 128 THEN {BYTE.format('{0}')} ELSE {BYTE.format('{0} % 128 + 128')} || {BYTE.format('{0} // 128')} END"
RECORD = f"""{RUNS}, c AS (SELECT node_id, CAST(dense_rank() OVER (ORDER BY node_id) - 1 AS BIGINT) AS outrank FROM (SELECT DISTINCT node_id FROM w)),
    k AS (SELECT count(*) AS sigma, {BYTE.format("count(*)")} || string_agg(CASE WHEN outrank = 0 THEN '0000' ELSE '0100' END, '' ORDER BY outrank) AS head, 256 // count(*) AS room FROM c),
    y AS (SELECT path_id, run, len, CASE WHEN len < room THEN {BYTE.format("outrank + sigma * (len - 1)")} ELSE {BYTE.format("outrank + sigma * (room - 1)")} || {NUMBER.format("(len - room)")} END AS code FROM r JOIN c USING (node_id), k)"""


def event_records(spark, d) -> DataFrame:
    """Runs of each walk over the event types as record bytes: path_id, data."""
    w = t.event_walks(spark, d)
    codes = w.select("node_id").distinct().select("node_id", (F.dense_rank().over(Window.orderBy("node_id")) - 1).cast("bigint").alias("outrank"))  # a few types
    r = walks.runs(w).join(codes, "node_id").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("run", "outrank", "len"))).alias("r"))
    n = codes.agg(F.array_sort(F.collect_list(F.struct(F.col("outrank").alias("to"), F.lit(0).cast("bigint").alias("rank_offset")))).alias("outgoing"))
    return r.join(F.broadcast(n), F.lit(True)).select("path_id", codec.record_bytes(F.col("outgoing"), F.transform("r", lambda x: F.struct(x["outrank"].alias("outrank"), x["len"].alias("len")))).alias("data"))  # n is one row, an entry an event type


@query(f"WITH {RECORD} SELECT path_id, (SELECT head FROM k) || string_agg(code, '' ORDER BY run) AS data, CAST(sum(len) AS BIGINT) AS total, count(*) AS runs FROM y GROUP BY 1")
def record_codec(spark, d):
    """Runs of each walk over the event types, as record bytes and read again."""
    back = event_records(spark, d).select("path_id", "data", codec.record_struct(F.col("data")).alias("s"))
    return back.select("path_id", F.hex("data").alias("data"), codec.run_total(F.col("s.runs")).alias("total"), F.size("s.runs").cast("bigint").alias("runs"))


@query(f"WITH {W2} SELECT DISTINCT path_id, path_id % 4 = 0 AS valid FROM w")
def record_validity(spark, d):
    """Whole records and broken ones: of 127 edges, which their bytes do not hold; empty; one byte after no edges."""
    rows = event_records(spark, d)
    kind = F.pmod("path_id", F.lit(4))
    rest = F.expr("substring(data, 2, length(data))")
    data = F.when(kind == 1, F.concat(F.unhex(F.lit("7F")), rest)).when(kind == 2, F.unhex(F.lit(""))).when(kind == 3, F.unhex(F.lit("0005"))).otherwise(F.col("data"))
    return rows.select("path_id", codec.record_valid(data).alias("valid"))


@query(
    f"""WITH {W1}, z AS (SELECT *, lpad(CAST(node_id AS VARCHAR), 8, '0') AS digits FROM w),
    p AS (SELECT path_id, step, node_id, lead(node_id) OVER x AS to_node, coalesce(lag(digits, 1) OVER x, '') || coalesce(lag(digits, 2) OVER x, '') || coalesce(lag(digits, 3) OVER x, '') || coalesce(lag(digits, 4) OVER x, '') || CASE WHEN step > 5 THEN (SELECT string_agg(o.digits, '' ORDER BY o.step DESC) FROM z o WHERE o.path_id = z.path_id AND o.step < z.step - 4) ELSE '' END AS prefix FROM z WINDOW x AS (PARTITION BY path_id ORDER BY step)),
    q AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY prefix, path_id) - 1 AS position FROM p)
    SELECT a.path_id, CAST(a.step AS BIGINT) AS step, a.node_id, a.position, a.to_node, b.position AS next_position FROM q a JOIN q b ON a.path_id = b.path_id AND b.step = a.step + 1"""
)
def lf_mapping(spark, d):
    return walks.lf_positions(t.part_walks(spark, d))


@query(f"WITH {W3} SELECT path_id, string_agg(node_id, '>' ORDER BY step) AS walk, count(*) AS steps FROM w GROUP BY 1")
def walk_trace(spark, d):
    return walks.traversals(t.role_walks(spark, d)).select("path_id", F.col("allele").alias("walk"), F.size(F.split("allele", ">")).cast("bigint").alias("steps"))


@query(f"WITH {W3}, a AS (SELECT path_id, string_agg(node_id, '>' ORDER BY step) AS allele FROM w GROUP BY 1) SELECT path_id, allele, dense_rank() OVER (ORDER BY allele) - 1 AS allele_id FROM a")
def allele_string(spark, d):
    return walks.traversals(t.role_walks(spark, d))


@query("SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders")
def delta_ids(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey", 1, 0).over(w)).alias("delta"))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS value FROM orders")
def undelta_ids(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("i")
    rows = delta_ids(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint"))
    return rows.select("o_custkey", "i", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


@query("SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS stop FROM documents")
def record_slices(spark, d):
    rows = ordered.running_sum(t.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), "stop")
    return rows.select("doc_id", (F.col("stop") - F.col("n_chars")).alias("start"), "stop")


@query("WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER x THEN 1 ELSE 0 END AS first FROM events WINDOW x AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id, CAST(sum(first) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS block_id FROM f")
def block_ids(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("bigint")
    rows = t.table(spark, d, "events").select("event_id", "user_id", first.alias("first"))
    return rows.select("event_id", "user_id", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("block_id"))


@query("WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER x THEN 1 ELSE 0 END AS first FROM events WINDOW x AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY event_id) AS block_id FROM f) SELECT user_id, CAST(block_id AS BIGINT) AS block_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS size, count(*) = 1 AS single FROM b GROUP BY user_id, block_id")
def block_summary(spark, d):
    rows = block_ids(spark, d).groupBy("user_id", "block_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("size"))
    return rows.withColumn("single", F.col("size") == 1)


# Joins: as-of, intervals, dictionaries


@query(f"WITH {SEGMENTS} SELECT o_orderkey, start_node FROM orders ASOF LEFT JOIN g ON o_orderkey >= start_node")
def asof_segment(spark, d):
    return ordered.as_of(t.table(spark, d, "orders").select("o_orderkey"), t.segment_starts(spark, d), "o_orderkey", "start_node", "segment").select("o_orderkey", F.col("segment").alias("start_node"))


@query(f"WITH {SEGMENTS} SELECT name, start_node, lead(start_node, 1, (SELECT max(o_orderkey) + 1 FROM orders)) OVER (ORDER BY start_node) AS end_node FROM g")
def segment_intervals(spark, d):
    last = t.table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("stop"))
    return ordered.neighbour(t.segment_starts(spark, d), "start_node", "next", after=True).join(F.broadcast(last), F.lit(True)).select("name", "start_node", F.coalesce("next", "stop").alias("end_node"))  # one row


@query(
    f"""WITH {W4}, p AS (SELECT max_by(node_id, step) AS node FROM w GROUP BY path_id), m AS (SELECT greatest(10, max(o_orderkey) // 500) AS gap FROM orders),
    b AS (SELECT node, CASE WHEN node - lag(node) OVER (ORDER BY node) > gap THEN 1 ELSE 0 END AS new FROM p, m), r AS (SELECT node, sum(new) OVER (ORDER BY node) AS range_id FROM b)
    SELECT CAST(range_id AS BIGINT) AS range_id, min(node) AS start_node, max(node) AS end_node, count(*) AS endpoints FROM r GROUP BY 1"""
)
def contig_gap_ranges(spark, d):
    """Ranges between large gaps in the sorted ends of the walks."""
    ends = t.order_walks(spark, d).groupBy("path_id").agg(F.max_by("node_id", "step").alias("node"))
    gap = t.table(spark, d, "orders").agg(F.greatest(F.lit(10), F.floor(F.max("o_orderkey") / 500)).alias("gap"))
    rows = ordered.neighbour(ends, "node", "before").join(F.broadcast(gap), F.lit(True))  # one row
    new = F.coalesce((F.col("node") - F.col("before") > F.col("gap")).cast("bigint"), F.lit(0))
    return ordered.running_sum(rows, "node", new, "range_id").groupBy("range_id").agg(F.min("node").alias("start_node"), F.max("node").alias("end_node"), F.count("*").alias("endpoints"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation")
def dictionary_encode(spark, d):
    return t.table(spark, d, "nation").select("n_name", (F.row_number().over(Window.orderBy("n_name")) - 1).cast("bigint").alias("id"))  # a dictionary is small


@query("SELECT c_custkey, coalesce(n_name, '?') AS contig FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dictionary_join(spark, d):
    n = t.table(spark, d, "nation").select("n_nationkey", "n_name")
    return t.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("contig"))


@query("SELECT o_custkey AS sample, count(*) AS paths FROM orders GROUP BY 1")
def paths_per_sample(spark, d):
    return t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("paths"))


@query("SELECT l_suppkey, l_partkey, max(l_orderkey) AS last_order, max_by(l_linenumber, (l_orderkey, l_linenumber, l_shipdate)) AS line FROM lineitem GROUP BY ALL")
def link_last_wins(spark, d):
    return t.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("last_order"), F.max_by("l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_shipdate")).alias("line"))


@query("SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events")
def tags_parse(spark, d):
    rows = t.table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))
    return rows.select("event_id", F.lower("key").alias("key"), "value")


@query("WITH p AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders), n AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, prev, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM p JOIN n a ON a.k = o_orderkey JOIN n b ON b.k = prev")
def walk_jaccard(spark, d):
    """Shared nodes of each customer's successive orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = t.table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev")).where("prev is not null")
    n = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("s"))
    both = p.join(n.toDF("o_orderkey", "a"), "o_orderkey").join(n.toDF("prev", "b"), "prev")
    return both.select("o_orderkey", "prev", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


@query(f"WITH {W3}, a AS (SELECT path_id, string_agg(node_id, '>' ORDER BY step) AS allele FROM w GROUP BY 1) SELECT allele, count(*) AS paths, round(count(*) / sum(count(*)) OVER (), 6) AS frequency FROM a GROUP BY 1")
def allele_frequency(spark, d):
    rows = walks.traversals(t.role_walks(spark, d)).groupBy("allele").agg(F.count("*").alias("paths"))
    total = rows.agg(F.sum("paths").alias("all"))
    return rows.join(F.broadcast(total), F.lit(True)).select("allele", "paths", F.round(F.col("paths") / F.col("all"), 6).alias("frequency"))  # one row


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, max(event_type) FILTER (WHERE k = 1) || '|' || coalesce(max(event_type) FILTER (WHERE k = 2), '.') AS genotype, coalesce(max(n) FILTER (WHERE k = 1) = max(n) FILTER (WHERE k = 2), false) AS conflict FROM r GROUP BY 1")
def genotype_call(spark, d):
    """Each sample's two best supported alleles; a tie between them is a conflict."""
    c = t.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")))
    at = lambda col, k: F.max(F.when(F.col("k") == k, F.col(col)))
    return r.groupBy("user_id").agg(F.concat(at("event_type", 1), F.lit("|"), F.coalesce(at("event_type", 2), F.lit("."))).alias("genotype"), F.coalesce(at("n", 1) == at("n", 2), F.lit(False)).alias("conflict"))


@query("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars + 1 AS BIGINT) AS position FROM documents")
def site_coordinate(spark, d):
    """Where each node starts on its reference walk."""
    rows = t.table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ordered.running_sum_by(rows, "source", "doc_id", F.col("n_chars"), "stop").select("source", "doc_id", (F.col("stop") - F.col("n_chars") + 1).alias("position"))


@query("SELECT c_custkey, coalesce(CAST(count(o_orderkey) AS VARCHAR), '*') AS n, CASE WHEN count(o_orderkey) = 0 THEN '*' ELSE CAST(min(o_orderkey) AS VARCHAR) END AS allele FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def star_allele(spark, d):
    """A parent without a traversal of the nested site gets the star allele."""
    o = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return t.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("string").alias("n"), F.coalesce(F.col("first").cast("string"), F.lit("*")).alias("allele"))


# Sequences


@query(f"WITH {SEQ} SELECT doc_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM q")
def reverse_complement(spark, d):
    return t.sequences(spark, d).select("doc_id", dna.reverse_complement(F.col("seq")).alias("rc"))


COUNTS = ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}" for b in "ACGTN")


@query(f"WITH {SEQ} SELECT doc_id, CAST(length(seq) AS BIGINT) AS bases, {COUNTS} FROM q")
def base_composition(spark, d):
    return t.sequences(spark, d).select("doc_id", F.length("seq").cast("bigint").alias("bases"), *(dna.count_base(F.col("seq"), b).cast("bigint").alias(f"n_{b.lower()}") for b in "ACGTN"))


@query(f"WITH {SEQ} SELECT CAST(sum(length(seq)) AS BIGINT) AS bases, CASE WHEN bool_or(contains(seq, 'N')) THEN 3 ELSE 2 END AS bits FROM q")
def base_format(spark, d):
    return t.sequences(spark, d).agg(F.sum(F.length("seq")).alias("bases"), F.when(F.bool_or(F.contains("seq", F.lit("N"))), 3).otherwise(2).alias("bits"))


@query(
    f"""WITH {SEQ}, b AS (SELECT doc_id, translate(replace(seq, 'N', ''), 'ACGT', '0123') AS s FROM q), i AS (SELECT doc_id, s, unnest(range(0, (length(s) + 14) // 15)) AS k FROM b),
    p AS (SELECT doc_id, k, substr(s, CAST(15 * k + 1 AS BIGINT), 15) AS part FROM i)
    SELECT doc_id, k AS word_no, CAST(list_sum([CAST(part[j] AS BIGINT) * (1::BIGINT << CAST(2 * (j - 1) AS INTEGER)) for j in range(1, length(part) + 1)]) - CASE WHEN length(part) = 15 THEN 2147483648 ELSE 0 END AS INTEGER) AS word FROM p"""
)
def dna_pack(spark, d):
    rows = t.sequences(spark, d).select("doc_id", F.posexplode(dna.pack(F.replace("seq", F.lit("N"), F.lit("")))).alias("k", "word"))
    return rows.select("doc_id", F.col("k").cast("bigint").alias("word_no"), "word")


@query(f"WITH {SEQ} SELECT doc_id, replace(seq, 'N', '') AS seq FROM q")
def dna_unpack(spark, d):
    s = F.replace("seq", F.lit("N"), F.lit(""))
    rows = t.sequences(spark, d).select("doc_id", dna.pack(s).alias("words"), F.length(s).alias("n"))
    return rows.select("doc_id", dna.unpack(F.col("words"), F.col("n")).alias("seq"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS preview FROM documents ORDER BY doc_id LIMIT 10")
def head_preview(spark, d):
    return t.table(spark, d, "documents").orderBy("doc_id").limit(10).select("doc_id", F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 57), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


K = 24


@query(f"WITH k AS (SELECT DISTINCT item_id, substr(text, p, {K}) AS kmer FROM (SELECT item_id, text, unnest(range(1, greatest(0, length(text) - {K} + 1) + 1)) AS p FROM benchmark)), s AS (SELECT doc_id, substr(text, p, {K}) AS kmer FROM (SELECT doc_id, text, unnest(range(1, greatest(0, length(text) - {K} + 1) + 1)) AS p FROM documents)) SELECT doc_id, item_id, count(*) AS hits FROM s JOIN k USING (kmer) GROUP BY ALL")
def seed_extend(spark, d):
    """Exact seeds of the items in the documents: hits of each pair."""

    def kmers(df: DataFrame, key: str, block: int = 512) -> DataFrame:
        # blocks first: a substring's cost grows with its place in the string
        n = F.length("text") - K
        parts = df.where(n >= 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), n, F.lit(block)), lambda p: F.substring("text", p + 1, F.lit(block + K - 1)))).alias("part"))
        return parts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("part") - K + 1), lambda p: F.substring("part", p, F.lit(K)))).alias("kmer"))

    seeds = kmers(t.table(spark, d, "benchmark"), "item_id").distinct()
    return kmers(t.table(spark, d, "documents"), "doc_id").join(seeds, "kmer").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))


# Bits


@query("SELECT o_orderkey, (o_orderkey << 1) | 1 AS reverse_type, (o_orderkey << 1) >> 1 AS node_id, CASE WHEN o_orderkey & 1 = 0 THEN 2 ELSE 3 END AS orientation, (o_custkey << 32) | o_orderkey AS packed FROM orders")
def bit_split(spark, d):
    k = F.col("o_orderkey")
    rows = t.table(spark, d, "orders").select("o_orderkey", bits.node_type(k, F.lit(1)).alias("reverse_type"), bits.node_of(bits.node_type(k, F.lit(0))).alias("node_id"), bits.edge_orientation(k).alias("orientation"), bits.pack_pair(k, F.col("o_custkey")).alias("packed"))
    return rows


@query("SELECT o_orderkey, o_orderkey AS low, o_custkey AS high FROM orders")
def unpack_pairs(spark, d):
    low, high = bits.unpack_pair(bits.pack_pair(F.col("o_orderkey"), F.col("o_custkey")))
    return t.table(spark, d, "orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query("SELECT o_custkey, CAST(greatest(1, length(bin(max(o_orderkey)))) AS BIGINT) AS width FROM orders GROUP BY 1")
def int_width(spark, d):
    return t.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m")).select("o_custkey", bits.width_for(F.col("m")).cast("bigint").alias("width"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey AS v, row_number() OVER x - 1 AS i, CAST(greatest(1, length(bin((max(o_orderkey) OVER (PARTITION BY o_custkey) + 1) // count(*) OVER (PARTITION BY o_custkey))) - 1) AS INTEGER) AS w FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, v, CAST(w AS BIGINT) AS low_width, v & ((1 << w) - 1) AS low, (v >> w) + i AS high FROM c"""
)
def elias_fano(spark, d):
    """Sorted sets split into low bits and unary-coded high parts."""
    p = Window.partitionBy("o_custkey")
    rows = t.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("v"), (F.row_number().over(p.orderBy("o_orderkey")) - 1).alias("i"), bits.low_width(F.max("o_orderkey").over(p) + 1, F.count("*").over(p)).alias("w"))
    return rows.select("o_custkey", "v", F.col("w").cast("bigint").alias("low_width"), F.expr("v & (shiftleft(1L, w) - 1)").alias("low"), F.expr("shiftright(v, w) + i").alias("high"))


@query("SELECT o_custkey, o_orderkey AS v FROM orders")
def elias_fano_decode(spark, d):
    rows = elias_fano(spark, d)
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("high")) - 1
    return rows.withColumn("i", i).select("o_custkey", F.expr("shiftleft(high - i, cast(low_width as int)) | low").alias("v"))


@query(f"WITH {W4}, z AS (SELECT *, CAST(1 AS INTEGER) * CAST(step = 1 AS INTEGER) + 2 * CAST(step = max(step) OVER (PARTITION BY path_id) AS INTEGER) AS flags FROM w) SELECT node_id, flags, flags & 1 <> 0 AS starts, flags & 2 <> 0 AS ends FROM z")
def block_flags(spark, d):
    w = t.order_walks(spark, d)
    last = F.max("step").over(Window.partitionBy("path_id"))
    flags = F.when(F.col("step") == 1, bits.BLOCK_START).otherwise(0).bitwiseOR(F.when(F.col("step") == last, bits.BLOCK_END).otherwise(0))
    return w.select("node_id", flags.alias("flags")).select("node_id", "flags", bits.has(F.col("flags"), bits.BLOCK_START).alias("starts"), bits.has(F.col("flags"), bits.BLOCK_END).alias("ends"))


# Graph traversals


@query(f"WITH {W4} SELECT node_id, first_value(node_id) OVER (PARTITION BY path_id ORDER BY step) AS block_id, step - 1 AS ord FROM w")
def unitig_blocks(spark, d):
    w = t.order_walks(spark, d)
    return graph.unitigs(walks.support(w), walks.nodes(w))


@query(f"WITH {W4} SELECT node_id, min(node_id) OVER (PARTITION BY path_id) AS component FROM w")
def graph_components(spark, d):
    w = t.order_walks(spark, d)
    return graph.components(walks.support(w), walks.nodes(w))


@query(
    f"""WITH {W4}, x AS (SELECT *, lead(node_id) OVER (PARTITION BY path_id ORDER BY step) AS t FROM w)
    SELECT CAST(node_id // 5000 AS BIGINT) AS range_id, node_id, step - 1 AS ord, CAST(t IS NOT NULL AS INTEGER) AS edge_count, CAST(CAST(step = 1 AS INTEGER) + 2 * CAST(t IS NULL AS INTEGER) AS SMALLINT) AS flags,
    coalesce(CAST(t AS VARCHAR), '') AS edges, CASE WHEN t IS NULL THEN '' ELSE '2' END AS orientations, substr(translate(md5(CAST(node_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 17) AS seq FROM x"""
)
def block_rows(spark, d):
    """The chains of the order graph, written as block rows and read back."""
    w = t.order_walks(spark, d)
    e = walks.support(w)
    out = e.groupBy(F.col("from_node").alias("node_id")).agg(F.array_sort(F.collect_list(bits.node_type(F.col("to_node"), F.lit(0)))).alias("targets"))
    seq = F.substring(F.translate(F.md5(F.col("node_id").cast("string")), "0123456789abcdef", "ACGT" * 4), 1, 17)
    rows = graph.unitigs(e, walks.nodes(w)).join(out, "node_id", "left").select(F.expr("node_id div 5000").alias("range_id"), "ord", "node_id", seq.alias("seq"), "targets", (F.col("ord") == 0).alias("is_start"), F.col("targets").isNull().alias("is_end"))
    path = new_path(spark, "block-rows")
    rows_sink.write(rows, path)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows_sink.read(spark, path).select("range_id", "node_id", "ord", "edge_count", "flags", joined("edges").alias("edges"), joined("edge_orientations").alias("orientations"), "seq")


def drawn(what: str, key: str, n: int) -> str:
    return f"CAST('0x' || substr(md5('42:{what}:' || {key}), 1, 12) AS BIGINT) % {n}"


@query(
    f"""WITH n AS (SELECT range AS id, range % 400 AS p FROM range(24000)), c AS (
        SELECT id + 1 AS from_node, unnest(CASE WHEN p >= 150 AND p % 150 = 0 AND p + 2 < 400 THEN [2] WHEN (p + 1) % 150 = 0 AND p + 3 < 400 THEN [1, 2] WHEN p = 399 THEN [] ELSE [1] END) AS step FROM n),
    y AS (SELECT DISTINCT {drawn("cycle", "range", 60)} AS c FROM range(30)),
    o AS (SELECT range AS i, {drawn("from", "range", 60)} AS a, {drawn("to", "range", 60)} AS b FROM range(100))
    SELECT from_node, from_node + step AS to_node FROM c UNION ALL SELECT (c + 1) * 400, c * 400 + 1 FROM y
    UNION ALL SELECT DISTINCT a * 400 + 1 + {drawn("from node", "i", 400)}, b * 400 + 1 + {drawn("to node", "i", 400)} FROM o WHERE a <> b"""
)
def synthetic_edges(spark, d):
    return synthetic.edges(spark, 60, 400)


@query(
    f"""SELECT range AS node_id, (range - 1) // 400 AS contig, substr(translate(md5('42:bases:' || range), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(5 + {drawn("length", "range", 5)} AS BIGINT)) AS seq FROM range(1, 24001)"""
)
def synthetic_sequences(spark, d):
    return synthetic.sequences(spark, 60, 400)


LOOPED = f"""n AS (SELECT range AS id, range % 400 AS p FROM range(24000)), c AS (
        SELECT id + 1 AS from_node, unnest(CASE WHEN p = 399 OR (p > 150 AND p % 150 = 2) THEN [] WHEN p >= 150 AND p % 150 = 0 THEN CASE WHEN p + 2 < 400 THEN [2] ELSE [] END WHEN p > 150 AND p % 150 = 1 THEN [1] WHEN (p + 1) % 150 = 0 AND p + 3 < 400 THEN [1, 1, 2] ELSE [1] END) AS step FROM n),
    y AS (SELECT DISTINCT {drawn("cycle", "range", 60)} AS c FROM range(30)),
    o AS (SELECT range AS i, {drawn("from", "range", 60)} AS a, {drawn("to", "range", 60)} AS b FROM range(100)),
    e AS (SELECT from_node, from_node + step AS to_node FROM c UNION ALL SELECT (c + 1) * 400, c * 400 + 1 FROM y
    UNION ALL SELECT a * 400 + 1 + {drawn("from node", "i", 400)}, b * 400 + 1 + {drawn("to node", "i", 400)} FROM o WHERE a <> b UNION ALL SELECT 0, (range + 1) * 400 FROM range(60))"""


@query(f"WITH {LOOPED} SELECT from_node, to_node FROM e")
def synthetic_looped(spark, d):
    return synthetic.looped_edges(spark, 60, 400)


@query(f"WITH {LOOPED}, g AS (SELECT from_node, count(*) AS n, string_agg(2 * to_node, ',' ORDER BY to_node) AS t FROM e GROUP BY 1) SELECT 2 * range + o AS type, coalesce(n, 0) AS edges, coalesce(t, '') AS targets, CASE WHEN n > 0 THEN 10 ELSE 0 END AS haplotypes FROM range(24001) CROSS JOIN (SELECT unnest([0, 1]) AS o) LEFT JOIN g ON from_node = range")
def synthetic_records(spark, d):
    """Records of the looped graph: edges, targets, and the haplotypes that their runs add up to."""
    rows = synthetic.looped_records(spark, 60, 400)
    targets = F.array_join(F.transform("outgoing", lambda o: o["to"].cast("string")), ",")
    return rows.select("type", F.size("outgoing").cast("bigint").alias("edges"), targets.alias("targets"), codec.run_total(F.col("runs")).cast("int").alias("haplotypes"))


from . import blocks, files  # noqa: E402, F401  (they enter more queries)
