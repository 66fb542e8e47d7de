"""Graph operators: chains by pointer doubling, ordered traversal per range, components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered
from .storage import drop, materialize


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    return materialize(df, "cut")


def unitigs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Maximal chains u -> v with one way out of u and one into v: node_id, block_id (the chain's first
    node), ord. Pointer doubling: the number of rounds is the logarithm of the longest chain. A cycle
    is cut before its smallest node."""
    one_out = edges.groupBy("from_node").agg(F.min("to_node").alias("to_node"), F.count("*").alias("n")).where("n = 1")
    one_in = edges.groupBy("to_node").agg(F.count("*").alias("m")).where("m = 1")
    back = cut(one_out.join(one_in, "to_node").where("from_node <> to_node").select(F.col("to_node").alias("node_id"), F.col("from_node").alias("up")))
    # up: a node so many places before; low: the smallest node passed on the way, itself included
    state = nodes.join(back, "node_id", "left").select("node_id", F.coalesce("up", "node_id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.least("node_id", F.coalesce("up", "node_id")).alias("low"))
    state, n = cut(state), nodes.count()
    for _ in range(max(1, n.bit_length())):  # after that, every pointer is at a chain's head or on a cycle
        far = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("low").alias("low2"))
        state = cut(state.join(far, "up").select("node_id", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low")))
        if state.join(back.select(F.col("node_id").alias("up")), "up", "left_semi").isEmpty():
            break
    on_chain = state.join(back.select(F.col("node_id").alias("up")), "up", "left_anti").select("node_id", F.col("up").alias("block_id"), F.col("d").alias("ord"))
    on_cycle = state.join(back.select(F.col("node_id").alias("up")), "up", "left_semi").select("node_id", F.col("low").alias("block_id"))
    if on_cycle.isEmpty():
        return on_chain
    # open each cycle before its smallest node and number it by the same doubling
    opened = back.join(on_cycle.select("node_id"), "node_id", "left_semi").join(on_cycle.select(F.col("block_id").alias("node_id")).distinct(), "node_id", "left_anti")
    return on_chain.unionByName(unitigs(opened.select(F.col("up").alias("from_node"), F.col("node_id").alias("to_node")), on_cycle.select("node_id")))


def in_bounds(edges: DataFrame, last: int) -> DataFrame:
    """Edges whose target is a node: from 1 to last."""
    return edges.where(F.col("to_node").between(1, last))


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge of the whole graph leads to."""
    return nodes.select("node_id").distinct().join(edges.select(F.col("to_node").alias("node_id")), "node_id", "left_anti")


def tiling(endpoints: DataFrame, nodes: int, least: int = 1000, parts: int = 500) -> DataFrame:
    """(range_id, name, start_node, end_node): ranges that tile 1 to nodes, cut behind every endpoint after
    which the next one is more than max(least, nodes / parts) away. endpoints: node_id, any number of rows a node."""
    gap = max(least, nodes // parts)
    rows = ordered.neighbour(endpoints.select("node_id").where("node_id >= 1").distinct(), "node_id", "before")
    ends = rows.where(F.col("node_id") - F.col("before") > gap).select(F.col("before").alias("end_node"))
    if nodes < 1:
        return ends.limit(0).select(F.lit(0).cast("bigint").alias("range_id"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("start_node"), "end_node")
    ends = ends.where(F.col("end_node") < nodes).unionByName(ends.sparkSession.range(1).select(F.lit(nodes).cast("bigint").alias("end_node")))
    rows = ordered.number(ordered.neighbour(cut(ends), "end_node", "last"), "end_node", "range_id")
    return rows.select("range_id", F.concat(F.lit("ctg_"), F.when(F.col("range_id") < 100_000, F.lpad(F.col("range_id").cast("string"), 5, "0")).otherwise(F.col("range_id").cast("string"))).alias("name"), (F.coalesce("last", F.lit(0)) + 1).alias("start_node"), "end_node")


def longest_first(ranges: DataFrame) -> DataFrame:
    return ranges.withColumn("size", F.col("end_node") - F.col("start_node") + 1).orderBy(F.desc("size"), "start_node")


def dfs_blocks(adjacency: DataFrame) -> DataFrame:
    """Ordered traversal of each range into blocks. adjacency: range_id, start_node, end_node, node_id, targets
    (node ids in the order of the edges, those outside the range too), source (whether no edge of the whole
    graph leads to the node).

    A walk starts at the range's sources, the largest first, then at the smallest node left. A block goes on
    while the node has one way out, to a node of the range not seen yet. Sequential within a range, whose rows
    one task holds; ranges run in parallel."""
    return adjacency.groupBy("range_id").applyInPandas(_traverse, "range_id bigint, ord bigint, node_id bigint, block_id bigint, is_start boolean, is_end boolean")


def traverse(targets: dict[int, list[int]], starts: list[int], first: int, last: int) -> Iterator[tuple[int, int, bool, bool]]:
    """(node, block, starts, ends) in visiting order, of the range from first to last. A target of the range that
    is no key of targets is visited like others but has no row; the edge to it does not end a block."""
    stack = [(n, True) for n in sorted(starts)]
    every = targets.keys() | {t for own in targets.values() for t in own if first <= t <= last}
    rest, seen, block, going = iter(sorted(every)), set(), -1, False
    while True:
        if not stack:
            going = False
            n = next((n for n in rest if n not in seen), None)
            if n is None:
                return
            stack.append((n, True))
        n, fresh = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        if n not in targets:
            continue
        out = targets[n]
        start = fresh or not going
        block += start
        open_to = [t for t in out if first <= t <= last and t not in seen]
        end = len(out) != 1 or not open_to
        yield n, block, start, end
        going = not end
        stack += [(t, end) for t in reversed(open_to)]


def _traverse(pdf: pd.DataFrame) -> pd.DataFrame:
    targets = {int(n): [int(t) for t in own] for n, own in zip(pdf["node_id"], pdf["targets"], strict=True)}
    starts = [int(n) for n, source in zip(pdf["node_id"], pdf["source"], strict=True) if source]
    rows = [(int(pdf["range_id"].iloc[0]), i, *r) for i, r in enumerate(traverse(targets, starts, int(pdf["start_node"].iloc[0]), int(pdf["end_node"].iloc[0])))]
    return pd.DataFrame(rows, columns=["range_id", "ord", "node_id", "block_id", "is_start", "is_end"])


def in_ranges(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """nodes with the range_id, start_node and end_node of the range that they lie in; ranges tile the ids."""
    found = ordered.as_of(nodes, ranges.select("start_node"), "node_id", "start_node", "_first")
    return found.join(ranges.select(F.col("start_node").alias("_first"), "range_id", "start_node", "end_node"), "_first").drop("_first")


def decompose(records: DataFrame, ranges: DataFrame, sequences: DataFrame, paths_too: bool = True) -> DataFrame:
    """Rows for the sink of block rows, in the order of the traversal, from records by oriented node.

    records: type (2 * node + orientation), outgoing (to, rank_offset), runs (outrank, len). Rows come from the
    forward records, each with its oriented targets, its running sums of runs and its paths by edge; sources are
    the nodes that no record of any orientation leads to."""
    forward = records.where((F.col("type") >= 2) & (F.col("type") % 2 == 0)).select(F.shiftright("type", 1).alias("node_id"), F.transform("outgoing", lambda o: o["to"]).alias("oriented"), "runs")
    edges = records.where("type >= 2").select(F.explode("outgoing").alias("o")).select(F.shiftright("o.to", 1).alias("to_node"))
    source = sources(forward, edges).withColumn("source", F.lit(True))
    nodes = cut(in_ranges(forward, ranges).join(source, "node_id", "left").withColumn("source", F.coalesce("source", F.lit(False))))
    order = cut(dfs_blocks(nodes.select("range_id", "start_node", "end_node", "node_id", F.transform("oriented", lambda t: F.shiftright(t, 1)).alias("targets"), "source")))
    rows = order.join(nodes.select("node_id", F.col("oriented").alias("targets"), "runs"), "node_id").join(sequences.select("node_id", "seq"), "node_id", "left")
    if paths_too:
        sums = F.aggregate("runs", F.array(F.lit(0)), lambda s, r: F.concat(s, F.array((F.element_at(s, -1) + r["len"]).cast("int"))))
        by_edge = F.transform(F.sequence(F.lit(0), F.size("targets") - 1), lambda i: F.aggregate(F.filter("runs", lambda r: r["outrank"] == i), F.lit(0).cast("bigint"), lambda s, r: s + r["len"]).cast("int"))
        rows = rows.withColumn("rank_offsets", F.when(F.size("runs") > 0, sums)).withColumn("edge_support", F.when(F.size("targets") > 0, by_edge))
    return rows.drop("runs")


def extend(patterns: DataFrame, sequences: DataFrame, edges: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Walks whose labels read a pattern from its start: pattern_id, start_node, end_node, nodes. Labels have
    shortest to longest letters; a pattern may end within a label. Seeds are the nodes whose label a pattern begins
    with; then every round follows one edge, as long as the next label agrees. Ends when no walk goes on: a
    label takes one letter at least."""
    heads = patterns.withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.substring("pattern", F.lit(1), n)))))
    size = F.length("pattern")
    seeds = heads.join(sequences, F.col("head") == F.col("seq")).select("pattern_id", "pattern", F.col("node_id").alias("start_node"), "node_id", F.length("seq").alias("used"), F.lit(1).cast("bigint").alias("nodes"))
    walks, done = cut(seeds), None
    while True:
        ended = walks.where(F.col("used") >= size).select("pattern_id", "start_node", F.col("node_id").alias("end_node"), "nodes")
        done = cut(ended if done is None else done.unionByName(ended))
        going = walks.where(F.col("used") < size)
        if going.isEmpty():
            return done
        step = going.join(edges.select(F.col("from_node").alias("node_id"), "to_node"), "node_id").join(sequences.select(F.col("node_id").alias("to_node"), "seq"), "to_node")
        left = F.substring("pattern", F.col("used") + 1, F.least(F.length("seq"), size - F.col("used")))
        agrees = left == F.substring("seq", F.lit(1), F.length(left))
        walks = cut(step.where(agrees & (F.length("seq") > 0)).select("pattern_id", "pattern", "start_node", F.col("to_node").alias("node_id"), (F.col("used") + F.length("seq")).alias("used"), (F.col("nodes") + 1).alias("nodes")).distinct())


def flatten_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each block's nodes in order and the blocks that its last node leads to: block_id, nodes, children.
    blocks: node_id, block_id, ord."""
    own = blocks.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("s"))
    own = own.select("block_id", F.transform("s", lambda x: x["node_id"]).alias("nodes"))
    last = own.select("block_id", F.element_at("nodes", -1).alias("from_node"))
    to = blocks.select(F.col("node_id").alias("to_node"), F.col("block_id").alias("child"))
    children = last.join(edges.select("from_node", "to_node"), "from_node").join(to, "to_node").groupBy("block_id").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return own.join(children, "block_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, component: the smallest node reachable, by minimum labels and pointer jumping. Nodes without an
    edge take no part in the rounds."""
    both = cut(edges.select("from_node", "to_node").union(edges.select("to_node", "from_node")).where("from_node <> to_node").distinct())
    label = both.groupBy(F.col("from_node").alias("node_id")).agg(F.least(F.first("from_node"), F.min("to_node")).alias("component"))
    label, seen = cut(label), None
    for _ in range(100):
        old = label
        low = both.join(label, both["to_node"] == label["node_id"]).groupBy("from_node").agg(F.min("component").alias("m"))
        label = label.join(low, label["node_id"] == low["from_node"]).select("node_id", F.least("component", "m").alias("component"))
        jump = label.select(F.col("node_id").alias("component"), F.col("component").alias("c2"))
        label = cut(label.join(jump, "component").select("node_id", F.least("component", "c2").alias("component")))
        drop(old)
        now = label.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            return nodes.select("node_id").join(label, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
