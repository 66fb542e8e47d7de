"""Relational operators on walks. A walk table has path_id, step (from 1) and node_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import graph, ordered


def path() -> WindowSpec:
    return Window.partitionBy("path_id").orderBy("step")


def numbered(df: DataFrame, key: str, order: list[str], node: F.Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias("path_id"), F.row_number().over(w).cast("bigint").alias("step"), node.alias("node_id"))


def steps(walks: DataFrame) -> DataFrame:
    """Every step of a walk from a node to the next: path_id, step, from_node, to_node."""
    return walks.select("path_id", "step", F.col("node_id").alias("from_node"), F.lead("node_id").over(path()).alias("to_node")).where("to_node is not null")


def support(walks: DataFrame) -> DataFrame:
    return steps(walks).groupBy("from_node", "to_node").agg(F.count("*").alias("support"))


def nodes(walks: DataFrame) -> DataFrame:
    return walks.select("node_id").distinct()


def in_degree(walks: DataFrame, most: int | None = 2) -> DataFrame:
    n = support(walks).groupBy(F.col("to_node").alias("node_id")).agg(F.count("*").alias("n"))
    d = F.coalesce("n", F.lit(0))
    return nodes(walks).join(n, "node_id", "left").select("node_id", (d if most is None else F.least(d, F.lit(most))).cast("bigint").alias("in_degree"))


def out_degree(walks: DataFrame) -> DataFrame:
    n = support(walks).groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes(walks).join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("out_degree"))


def starts(walks: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes(walks).join(steps(walks).select(F.col("to_node").alias("node_id")), "node_id", "left_anti")


def runs(walks: DataFrame) -> DataFrame:
    """Run-length encoding of each walk: path_id, run, node_id, len."""
    at = F.row_number().over(path()) - F.row_number().over(Window.partitionBy("path_id", "node_id").orderBy("step"))
    islands = walks.withColumn("island", at).groupBy("path_id", "node_id", "island").agg(F.min("step").alias("first"), F.count("*").alias("len"))
    return islands.select("path_id", F.row_number().over(Window.partitionBy("path_id").orderBy("first")).cast("bigint").alias("run"), "node_id", "len")


def rank_offsets(walks: DataFrame) -> DataFrame:
    """Per run, the visits of its walk before it and with it."""
    w = Window.partitionBy("path_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return runs(walks).select("path_id", "run", "len", (F.sum("len").over(w) - F.col("len")).alias("rank_start"), F.sum("len").over(w).alias("rank_end"))


def frequency(walks: DataFrame) -> DataFrame:
    """Share of a node's outgoing steps that take each edge."""
    w = Window.partitionBy("from_node")
    return support(walks).select("from_node", "to_node", F.round(F.col("support") / F.sum("support").over(w), 6).alias("frequency"))


def outranks(walks: DataFrame) -> DataFrame:
    """Out-edges of each node numbered in the order they are first seen."""
    first = steps(walks).groupBy("from_node", "to_node").agg(F.min(F.struct("path_id", "step")).alias("first"))
    w = Window.partitionBy("from_node").orderBy("first")
    return first.select("from_node", "to_node", (F.row_number().over(w) - 1).cast("bigint").alias("outrank"))


def prefix_ranks(walks: DataFrame) -> DataFrame:
    """walks with rank: visits in the order of their reversed prefix (the node before, the one before that,
    ...; a prefix that ends sooner comes first). Equal prefixes have equal ranks. There may be 2^31 different ones.

    Rank doubling: ranks by 2k nodes back come from pairs of ranks by k, the own and that of the visit k steps
    before. The number of rounds is the logarithm of the longest walk. Pairs are numbered by ordered scans."""
    start = walks.groupBy("path_id").agg(F.max("step").alias("n")).agg(F.max("n")).first()[0] or 0
    first = F.coalesce(F.lag("node_id").over(path()) + 1, F.lit(0))  # 0: there is no node before
    rows, back = walks.withColumn("rank", first), 1
    while True:
        keys = rows.select("rank").distinct()
        dense = ordered.number(keys, "rank", "dense", 1 << 16 if back == 1 else 1 << 40)
        rows = graph.cut(rows.join(dense, "rank").drop("rank").withColumnRenamed("dense", "rank"))
        if back >= start:
            return rows
        other = F.coalesce(F.lag("rank", back).over(path()) + 1, F.lit(0))
        rows, back = rows.withColumn("rank", F.shiftleft("rank", 31).bitwiseOR(other)), 2 * back


def lf_positions(walks: DataFrame) -> DataFrame:
    """Position of each visit among its node's visits, ordered by reversed prefix, then path; and
    the position that following the edge gives: rank offset plus earlier visits with that edge."""
    walks = graph.cut(walks)
    pos = Window.partitionBy("node_id").orderBy("rank", "path_id")
    rows = prefix_ranks(walks).withColumn("to_node", F.lead("node_id").over(path()))
    rows = graph.cut(rows.select("path_id", "step", "node_id", "to_node", (F.row_number().over(pos) - 1).cast("bigint").alias("position")))
    same = Window.partitionBy("node_id", "to_node").orderBy("position")
    moved = rows.where("to_node is not null").withColumn("occ", F.row_number().over(same) - 1).join(edge_offsets(walks).withColumnRenamed("from_node", "node_id"), ["node_id", "to_node"])
    return moved.select("path_id", "step", "node_id", "position", "to_node", (F.col("offset") + F.col("occ")).cast("bigint").alias("next_position"))


def edge_offsets(walks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(from_node, to_node, offset): the visits at to_node that come before those by this edge, as they begin a
    walk there or arrive from a smaller node. edges: more of them, which no walk need take."""
    own = support(walks)
    if edges is not None:
        own = own.unionByName(edges.select("from_node", "to_node", F.lit(0).cast("bigint").alias("support"))).groupBy("from_node", "to_node").agg(F.sum("support").alias("support"))
    smaller = Window.partitionBy("to_node").orderBy("from_node").rowsBetween(Window.unboundedPreceding, -1)
    first_visits = walks.where("step = 1").groupBy(F.col("node_id").alias("to_node")).agg(F.count("*").alias("n"))
    before = own.select("from_node", "to_node", F.coalesce(F.sum("support").over(smaller), F.lit(0)).alias("o"))
    return before.join(first_visits, "to_node", "left").select("from_node", "to_node", (F.col("o") + F.coalesce("n", F.lit(0))).alias("offset"))


def records(walks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Compressed records of the walks, one row a node: node_id, outgoing (to, rank_offset, by target; 0 is the end
    of a walk), runs (outrank, len) of its visits in the order of their reversed prefixes. Row 0 holds where the
    walks begin, in the order of path_id. Nodes are positive. edges: more of them, which no walk need take."""
    walks = graph.cut(walks)
    rows = prefix_ranks(walks).select("node_id", "rank", "path_id", F.coalesce(F.lead("node_id").over(path()), F.lit(0)).alias("to_node"))
    begins = walks.where("step = 1").select(F.lit(0).cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("rank"), "path_id", F.col("node_id").alias("to_node"))
    rows = graph.cut(rows.unionByName(begins))
    targets = rows.select("node_id", "to_node")
    if edges is not None:
        targets = targets.union(edges.select("from_node", "to_node"))
    targets = targets.distinct().withColumn("outrank", F.row_number().over(Window.partitionBy("node_id").orderBy("to_node")) - 1)
    offsets = edge_offsets(walks, edges).select(F.col("from_node").alias("node_id"), "to_node", "offset")
    edges = targets.join(offsets, ["node_id", "to_node"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)).cast("bigint"))
    outgoing = edges.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("outrank", F.col("to_node").cast("bigint").alias("to"), F.col("offset").alias("rank_offset")))).alias("o"))
    order = Window.partitionBy("node_id").orderBy("rank", "path_id")
    own = Window.partitionBy("node_id", "outrank").orderBy("rank", "path_id")
    islands = rows.join(targets, ["node_id", "to_node"]).select("node_id", "outrank", F.row_number().over(order).alias("at"), F.row_number().over(own).alias("k"))
    runs = islands.groupBy("node_id", "outrank", (F.col("at") - F.col("k")).alias("island")).agg(F.min("at").alias("first"), F.count("*").alias("len"))
    runs = runs.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("first", F.col("outrank").cast("bigint").alias("outrank"), "len"))).alias("r"))
    none = F.expr("cast(array() as array<struct<first:int,outrank:bigint,len:bigint>>)")
    out = outgoing.join(runs, "node_id", "left").withColumn("r", F.coalesce("r", none))
    return out.select("node_id", F.transform("o", lambda x: F.struct(x["to"].alias("to"), x["rank_offset"].alias("rank_offset"))).alias("outgoing"), F.transform("r", lambda x: F.struct(x["outrank"].alias("outrank"), x["len"].alias("len"))).alias("runs"))


def choice_runs(walks: DataFrame) -> DataFrame:
    """Which way each node's visits go on, in the order of path_id and step, run-length encoded: node_id, run,
    outrank (of outranks()), len."""
    rows = steps(walks).join(outranks(walks), ["from_node", "to_node"])
    at = Window.partitionBy("from_node").orderBy("path_id", "step")
    own = Window.partitionBy("from_node", "outrank").orderBy("path_id", "step")
    rows = rows.select(F.col("from_node"), "outrank", F.row_number().over(at).alias("at"), F.row_number().over(own).alias("k"))
    rows = rows.groupBy(F.col("from_node").alias("node_id"), "outrank", (F.col("at") - F.col("k")).alias("island")).agg(F.min("at").alias("first"), F.count("*").alias("len"))
    return rows.select("node_id", F.row_number().over(Window.partitionBy("node_id").orderBy("first")).cast("bigint").alias("run"), "outrank", "len")


def node_visits(walks: DataFrame) -> DataFrame:
    """Each node's visits in the order of path_id and step: node_id, visits."""
    return walks.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("path_id", "step"))).alias("visits"))


def walk_numbers(walks: DataFrame) -> DataFrame:
    """path_id and its number among all paths, from 0."""
    return ordered.number(walks.select("path_id").distinct(), "path_id", "number")


def traced(links: DataFrame) -> DataFrame:
    """Walks from links (walk, line_no, from_node, to_node): walk, step (from 1), node_id.

    Of the links of a walk from one node the last line counts. A walk starts at its smallest node that none of its
    links leads to (without one it has no visits), follows the links and ends before a node it has seen.
    Doubling: each round joins jumps twice as long, so the rounds are the logarithm of the longest walk."""
    jump = graph.cut(links.groupBy("walk", "from_node").agg(F.max_by("to_node", "line_no").alias("to_node")))
    start = jump.select("walk", "from_node").join(jump.select("walk", F.col("to_node").alias("from_node")), ["walk", "from_node"], "left_anti")
    seen = start.groupBy("walk").agg(F.min("from_node").alias("node_id")).withColumn("step", F.lit(1).cast("bigint"))
    ahead, count = 1, -1
    while True:
        far = seen.join(jump.select("walk", F.col("from_node").alias("node_id"), "to_node"), ["walk", "node_id"]).select("walk", F.col("to_node").alias("node_id"), (F.col("step") + ahead).alias("step"))
        seen = graph.cut(seen.unionByName(far).groupBy("walk", "node_id").agg(F.min("step").alias("step")))
        now = seen.count()
        if now == count:
            return seen.select("walk", "step", "node_id")
        count, ahead = now, 2 * ahead
        second = jump.select("walk", F.col("from_node").alias("to_node"), F.col("to_node").alias("next"))
        jump = graph.cut(jump.join(second, ["walk", "to_node"]).select("walk", "from_node", F.col("next").alias("to_node")))


def between(walks: DataFrame, source: str, sink: str) -> DataFrame:
    """Traversals of the site between two nodes: path_id, step (of the source), allele (the nodes between, in
    order). Each visit of the sink closes the last visit of the source before it that is still open."""
    w = path().rowsBetween(Window.unboundedPreceding, -1)
    marks = walks.where(F.col("node_id").isin(source, sink)).withColumn("last", F.last(F.struct("step", "node_id")).over(path().rowsBetween(-1, -1)) if source != sink else F.last(F.struct("step", "node_id")).over(w))
    sites = marks.where((F.col("node_id") == sink) & (F.col("last.node_id") == source)).select("path_id", F.col("last.step").alias("first"), F.col("step").alias("stop"))
    inside = walks.join(sites, "path_id").where((F.col("step") > F.col("first")) & (F.col("step") < F.col("stop")))
    own = inside.groupBy("path_id", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"].cast("string")), ">").alias("allele"))
    return sites.join(own, ["path_id", "first"], "left").select("path_id", F.col("first").alias("step"), F.coalesce("allele", F.lit("")).alias("allele"))


def similar(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, jaccard) of keys, a below b, whose sets share threshold of their union or more. sets: key, item,
    distinct. Prefix filter: items are ordered from rare to common; two such sets share one of the first
    size - ceil(threshold * size) + 1 items of each, so only those are joined, and common items seldom are."""
    often = sets.groupBy("item").agg(F.count("*").alias("n"))
    own = sets.join(often, "item").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("s"))
    own = graph.cut(own.select("key", F.transform("s", lambda x: x["item"]).alias("items"), F.size("s").alias("size")))
    heads = own.select("key", "size", F.explode(F.slice("items", F.lit(1), F.expr(f"cast(size - ceil({threshold} * size) + 1 as int)"))).alias("item"))
    a, b = heads.alias("a"), heads.alias("b")
    near = (F.col("a.size") >= threshold * F.col("b.size")) & (F.col("b.size") >= threshold * F.col("a.size"))
    pairs = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.key") < F.col("b.key")) & near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("items").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    share = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (share / (F.size("x") + F.size("y") - share)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def clusters(sets: DataFrame, threshold: float) -> DataFrame:
    """node_id, component: keys joined by chains of similar sets."""
    links = similar(sets, threshold).select(F.col("a").alias("from_node"), F.col("b").alias("to_node"))
    return graph.components(links, sets.select(F.col("key").alias("node_id")).distinct())


def bubbles(walks: DataFrame) -> DataFrame:
    """Pairs of nodes with two or more distinct middles between them."""
    e = support(walks).select("from_node", "to_node").where("from_node <> to_node")
    hop = e.alias("x").join(e.alias("y"), F.col("x.to_node") == F.col("y.from_node")).where("x.from_node <> y.to_node")
    return hop.groupBy(F.col("x.from_node").alias("source"), F.col("y.to_node").alias("sink")).agg(F.count("*").alias("middles")).where("middles >= 2")


def traversals(walks: DataFrame) -> DataFrame:
    """Each walk's nodes in order as one string, and the number of that string among all."""
    rows = walks.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"].cast("string")), ">").alias("allele"))
    return rows.join(text_numbers(rows.select("allele"), "allele", "allele_id"), "allele")


def text_numbers(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct texts and their places in order. Texts are dealt to ranges, each is numbered by itself, and a
    table with one row a range carries the counts."""
    texts = graph.cut(rows.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = texts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return texts.withColumn("_at", own).join(carry, "_part").select(column, (F.col("_carry") + F.col("_at")).cast("bigint").alias(name))
