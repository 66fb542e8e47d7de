"""GFA text graphs as DataFrames: segments, links and walks, gzip by suffix; and their conversion to the binary
container and to block rows.

Nodes are numbered from 1 in the order of their lines; of repeated names the last line's node is meant by
links. An oriented node is 2 * node, plus 1 if it is read backwards. Links to names without a segment are
dropped. A link's SR tag (0 without one) says which walk it belongs to; walks are numbered by SR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import graph, ordered
from ..operators import walks as w
from . import block_rows, container


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (grows in file order) and fields of every line that is not blank."""
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return text.where(F.trim("value") != "").select("line_no", F.split("value", "\t").alias("f"))


def tags(fields: Column) -> Column:
    """A map of NAME:TYPE:VALUE fields; values keep further colons, the last of a name wins."""
    kept = F.filter(fields, lambda x: x.rlike("^[^:]+:[^:]*:"))
    pairs = F.transform(kept, lambda x: F.struct(F.split(x, ":", 3)[0].alias("key"), F.split(x, ":", 3)[2].alias("value")))
    return F.aggregate(pairs, F.expr("cast(map() as map<string, string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))


def segments(rows: DataFrame) -> DataFrame:
    f = F.col("f")
    return rows.where(f[0] == "S").select("line_no", f[1].alias("id"), f[2].alias("sequence"), tags(F.slice("f", 4, 1 << 20)).alias("tags"))


def links(rows: DataFrame) -> DataFrame:
    f = F.col("f")
    return rows.where(f[0] == "L").select("line_no", f[1].alias("from_id"), (f[2] == "+").alias("from_fwd"), f[3].alias("to_id"), (f[4] == "+").alias("to_fwd"), F.get(f, 5).alias("overlap"), tags(F.slice("f", 7, 1 << 20)).alias("tags"))


def walks(rows: DataFrame) -> DataFrame:
    """Visits of W lines: path by sample, haplotype, contig; step, segment id, orientation."""
    f = F.col("f")
    w = rows.where(f[0] == "W").select("line_no", f[1].alias("sample"), f[2].alias("haplotype"), f[3].alias("contig"), F.regexp_extract_all(f[6], F.lit("([<>][^<>]+)"), 1).alias("steps"))
    return w.select("line_no", "sample", "haplotype", "contig", F.posexplode("steps").alias("step", "s")).select("line_no", "sample", "haplotype", "contig", "step", F.expr("substring(s, 2)").alias("id"), (F.substring("s", 1, 1) == ">").alias("forward"))


def nodes(rows: DataFrame) -> DataFrame:
    """node_id, id, sequence, tags of the segments."""
    return ordered.number(segments(rows), "line_no", "node_id").select((F.col("node_id") + 1).alias("node_id"), "id", "sequence", "tags")


def oriented_links(rows: DataFrame, named: DataFrame) -> DataFrame:
    """walk (the SR tag), line_no, from_node and to_node (oriented) of the links between segments."""
    last = named.groupBy("id").agg(F.max("node_id").alias("node"))
    got = links(rows).join(last.select(F.col("id").alias("from_id"), F.col("node").alias("a")), "from_id").join(last.select(F.col("id").alias("to_id"), F.col("node").alias("b")), "to_id")
    return got.select(F.coalesce(F.try_element_at("tags", F.lit("SR")), F.lit("0")).cast("bigint").alias("walk"), "line_no", bits.node_type(F.col("a"), ~F.col("from_fwd")).alias("from_node"), bits.node_type(F.col("b"), ~F.col("to_fwd")).alias("to_node"))


def both_ways(found: DataFrame) -> DataFrame:
    """Walks (walk, step, node_id) as path_id 2 * number, and read backwards as the path_id after that."""
    numbered = w.walk_numbers(found.withColumnRenamed("walk", "path_id")).withColumnRenamed("path_id", "walk")
    rows = found.join(numbered, "walk").withColumn("n", F.max("step").over(Window.partitionBy("walk")))
    ahead = rows.select((2 * F.col("number")).alias("path_id"), "step", "node_id")
    return ahead.unionByName(rows.select((2 * F.col("number") + 1).alias("path_id"), (F.col("n") + 1 - F.col("step")).alias("step"), F.col("node_id").bitwiseXOR(F.lit(1)).alias("node_id")))


class Graph:
    """The tables of a GFA file: nodes, links, walks (walk, step, node_id, oriented) and records by oriented node
    (type, outgoing, runs), 0 for where the walks begin."""

    def __init__(self, spark: SparkSession, path: str):
        rows = lines(spark, path)
        self.nodes = graph.cut(nodes(rows))
        self.links = graph.cut(oriented_links(rows, self.nodes))
        self.walks = w.traced(self.links)
        self.count = self.nodes.count()
        back = self.links.select(F.col("to_node").bitwiseXOR(F.lit(1)).alias("from_node"), F.col("from_node").bitwiseXOR(F.lit(1)).alias("to_node"))
        edges = self.links.select("from_node", "to_node").union(back).distinct()
        made = w.records(both_ways(self.walks), edges)
        every = spark.range(2 * self.count + 1).select(F.when(F.col("id") > 0, F.col("id") + 1).otherwise(0).alias("type"))
        empty = [F.expr("cast(array() as array<struct<to:bigint,rank_offset:bigint>>)"), F.expr("cast(array() as array<struct<outrank:bigint,len:bigint>>)")]
        self.records = graph.cut(every.join(made.withColumnRenamed("node_id", "type"), "type", "left").select("type", F.coalesce("outgoing", empty[0]).alias("outgoing"), F.coalesce("runs", empty[1]).alias("runs")))

    def sequences(self) -> DataFrame:
        return self.nodes.select("node_id", F.col("sequence").alias("seq"))

    def names(self) -> tuple[str, str]:
        """Of the one sample, and of the one contig: the SN tag of the first segment."""
        first = self.nodes.where("node_id = 1").select(F.try_element_at("tags", F.lit("SN"))).first()
        return "GFA_SAMPLE", (first[0] if first else None) or "chr1"

    def paths(self) -> DataFrame:
        number = w.walk_numbers(self.links.select(F.col("walk").alias("path_id")))
        zero = F.lit(0).cast("bigint")
        return number.select(F.col("number").alias("path_id"), zero.alias("sample"), zero.alias("contig"), F.col("path_id").alias("phase"), zero.alias("fragment"))

    def write_container(self, path: str, zstd: bool = False) -> None:
        """The graph as a container, record_id = type - 1."""
        spark = self.nodes.sparkSession
        sample, contig = (spark.createDataFrame([(0, x)], "id bigint, name string") for x in self.names())
        records = self.records.select(F.greatest(F.col("type") - 1, F.lit(0)).alias("record_id"), "outgoing", "runs")
        container.write(path, records, self.sequences(), self.paths(), sample, contig, self.nodes.select(F.col("id").alias("name"), F.col("node_id").alias("start_node")), {"source": "GFA"}, zstd=zstd)

    def write_block_rows(self, path: str, ranges: DataFrame | None = None) -> None:
        """The graph decomposed into blocks, as rows of the columnar sink. Ranges are cut by the ends of the walks."""
        ends = self.records.where("type = 0").select(F.explode("outgoing").alias("o")).select(F.shiftright("o.to", 1).alias("node_id"))
        ranges = ranges if ranges is not None else graph.tiling(ends, self.count)
        # the end of a walk is no edge of the graph
        real = self.records.select("type", F.filter("outgoing", lambda o: o["to"] > 0).alias("outgoing"), F.when(F.exists("outgoing", lambda o: o["to"] == 0), F.transform(F.filter("runs", lambda r: r["outrank"] > 0), lambda r: F.struct((r["outrank"] - 1).alias("outrank"), r["len"].alias("len")))).otherwise(F.col("runs")).alias("runs"))
        block_rows.write(graph.decompose(real, ranges, self.sequences()), path)
