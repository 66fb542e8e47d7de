"""A synthetic graph of any size, as plans over spark.range: chains of nodes with bubbles, some closed to
cycles, some joined by cross edges. All choices come from md5 of a seed, so every run gives the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels have 5 to 9 bases.
SHORTEST, LENGTHS = 5, 5


def draw(seed: int, what: str, key: Column, n: int) -> Column:
    """A number below n chosen by the seed, the choice's name and a key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{what}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n


def sequences(spark: SparkSession, contigs: int, size: int, seed: int = 42) -> DataFrame:
    """node_id (from 1), contig, seq."""
    nodes = spark.range(1, contigs * size + 1).withColumnRenamed("id", "node_id")
    bases = F.translate(F.md5(F.concat(F.lit(f"{seed}:bases:"), F.col("node_id").cast("string"))), "0123456789abcdef", "ACGT" * 4)
    return nodes.select("node_id", F.expr(f"(node_id - 1) div {size}").alias("contig"), F.substring(bases, F.lit(1), (draw(seed, "length", F.col("node_id"), LENGTHS) + SHORTEST).cast("int")).alias("seq"))


def edges(spark: SparkSession, contigs: int, size: int, bubble: int = 150, cycles: int = 30, cross: int = 100, seed: int = 42) -> DataFrame:
    """from_node, to_node, distinct. At each multiple b of bubble within a contig, with room for it, b and b + 1
    are two ways from b - 1 to b + 2. cycles and cross are numbers of draws: of contigs whose last node leads
    to their first (repeats fall together) and of edges between contigs (within one: left out)."""
    at = f"(id % {size})"
    opens = f"({at} >= {bubble} and {at} % {bubble} = 0 and {at} + 2 < {size})"  # the first way
    before = f"(({at} + 1) % {bubble} = 0 and {at} + 3 < {size})"  # the node that branches
    steps = F.expr(f"case when {opens} then array(2L) when {before} then array(1L, 2L) when {at} = {size} - 1 then array() else array(1L) end")
    chain = spark.range(contigs * size).select((F.col("id") + 1).alias("from_node"), F.explode(steps).alias("step")).select("from_node", (F.col("from_node") + F.col("step")).alias("to_node"))
    i = F.col("id")
    c = draw(seed, "cycle", i, contigs)
    back = spark.range(cycles).select(((c + 1) * size).alias("from_node"), (c * size + 1).alias("to_node")).distinct()
    a, b = draw(seed, "from", i, contigs), draw(seed, "to", i, contigs)
    over = spark.range(cross).where(a != b).select((a * size + 1 + draw(seed, "from node", i, size)).alias("from_node"), (b * size + 1 + draw(seed, "to node", i, size)).alias("to_node")).distinct()
    return chain.unionByName(back).unionByName(over)


def looped_edges(spark: SparkSession, contigs: int, size: int, bubble: int = 150, cycles: int = 30, cross: int = 100, seed: int = 42) -> DataFrame:
    """from_node, to_node of another shape, with repeats. At each multiple b of bubble within a contig, b and b + 1 both
    lead to b + 2, which leads nowhere: the chain begins anew behind it. The node before b has three edges, two
    of them to b. Where b + 2 is past the contig's end, b and what follows it have none. Cross edges are drawn as
    often as cross says, repeats and all; node 0 leads to the last node of each contig."""
    p = f"(id % {size})"
    fits = lambda last: f"{p} + {last} < {size}"
    chain = f"""case when {p} = {size} - 1 or ({p} > {bubble} and {p} % {bubble} = 2) then array()
        when {p} >= {bubble} and {p} % {bubble} = 0 then if({fits(2)}, array(2L), array())
        when {p} > {bubble} and {p} % {bubble} = 1 then array(1L)
        when ({p} + 1) % {bubble} = 0 and {fits(3)} then array(1L, 1L, 2L) else array(1L) end"""
    own = spark.range(contigs * size).select((F.col("id") + 1).alias("from_node"), F.explode(F.expr(chain)).alias("step")).select("from_node", (F.col("from_node") + F.col("step")).alias("to_node"))
    i = F.col("id")
    c = draw(seed, "cycle", i, contigs)
    back = spark.range(cycles).select(((c + 1) * size).alias("from_node"), (c * size + 1).alias("to_node")).distinct()
    a, b = draw(seed, "from", i, contigs), draw(seed, "to", i, contigs)
    over = spark.range(cross).where(a != b).select((a * size + 1 + draw(seed, "from node", i, size)).alias("from_node"), (b * size + 1 + draw(seed, "to node", i, size)).alias("to_node"))
    ends = spark.range(contigs).select(F.lit(0).cast("bigint").alias("from_node"), ((i + 1) * size).alias("to_node"))
    return own.unionByName(back).unionByName(over).unionByName(ends)


def looped_records(spark: SparkSession, contigs: int, size: int, haplotypes: int = 10, seed: int = 42) -> DataFrame:
    """Records of looped_edges by oriented node: type, outgoing (by target, rank offsets 0), runs. The haplotypes of a
    node are dealt to its edges in order, each taking a drawn part of what is left and the last the rest; a
    record read backwards is a copy. Type 0 and 1 are the sentinel's, whose haplotypes take its edges by turns."""
    edges = looped_edges(spark, contigs, size, seed=seed).groupBy("from_node").agg(F.array_sort(F.collect_list("to_node")).alias("targets"))
    nodes = spark.range(contigs * size + 1).select(F.col("id").alias("from_node")).join(edges, "from_node", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))
    n = F.size("targets")

    def deal(state: Column, e: Column) -> Column:
        left = state["left"]
        part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:share:"), F.col("from_node").cast("string"), F.lit(":"), e.cast("string"))), 1, 12), 16, 10).cast("bigint") % (left + 1)
        part = F.when(e == n - 1, left).otherwise(part)
        runs = F.when(part > 0, F.concat(state["runs"], F.array(F.struct(e.cast("bigint").alias("outrank"), part.alias("len"))))).otherwise(state["runs"])
        return F.struct((left - part).alias("left"), runs.alias("runs"))

    none = F.expr("cast(array() as array<struct<outrank:bigint,len:bigint>>)")
    dealt = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(haplotypes).cast("bigint").alias("left"), none.alias("runs")), deal)["runs"]
    turns = F.transform(F.sequence(F.lit(0), F.lit(haplotypes - 1)), lambda h: F.struct((h % n).cast("bigint").alias("outrank"), F.lit(1).cast("bigint").alias("len")))
    runs = F.when(n == 0, none).when(F.col("from_node") == 0, turns).otherwise(dealt)
    outgoing = F.transform("targets", lambda t: F.struct((2 * t).alias("to"), F.lit(0).cast("bigint").alias("rank_offset")))
    rows = nodes.select("from_node", outgoing.alias("outgoing"), runs.alias("runs"))
    return rows.select(F.explode(F.array(2 * F.col("from_node"), 2 * F.col("from_node") + 1)).alias("type"), "outgoing", "runs")
