"""The columnar sink of block rows: one row per node with packed label, edges and flags, as Parquet.

Edges are differences, the first from the node's own id; labels are packed words, with 3 bits a base in the
whole table if any label has an N; a folder per range.
Rows are dealt by (range_id, ord), so a large range is many files, each in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, dna

SCHEMA = (
    "ord bigint, node_id bigint, seq_len int, edge_count int, flags smallint, sequence array<int>, edges array<bigint>, "
    "edge_orientations array<tinyint>, contig_id int, position bigint, rank_offsets array<int>, edge_support array<int>, bits tinyint, range_id bigint"
)


def deltas(node: Column, targets: Column) -> Column:
    before = F.concat(F.array(node), F.slice(targets, 1, F.greatest(F.size(targets) - 1, F.lit(0))))
    return F.when(F.size(targets) > 0, F.zip_with(targets, before, lambda x, y: x - y)).otherwise(F.array().cast("array<bigint>"))


def undelta(node: Column, steps: Column) -> Column:
    """Running sums from the node's id. The list is copied for each edge: slow for nodes of very many edges."""
    return F.aggregate(steps, F.struct(node.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])


def encode(rows: DataFrame, bits_a_base: int | None = None) -> DataFrame:
    """rows: range_id, ord, node_id, seq (null: empty; other characters than bases raise), targets (oriented
    nodes), is_start, is_end; contig_id, position, rank_offsets (running sums of the node's run lengths from 0)
    and edge_support (paths by edge) where present. Absent ones are -1, -1 and empty. bits_a_base: found
    from the labels if not given."""
    width = bits_a_base or dna.format_bits(rows)
    seq, targets = F.coalesce("seq", F.lit("")), F.coalesce("targets", F.array().cast("array<bigint>"))
    optional = lambda name, default: F.coalesce(F.col(name), default) if name in rows.columns else default
    ranks = optional("rank_offsets", F.array().cast("array<int>")).cast("array<int>")
    flags = F.when(F.col("is_start"), bits.BLOCK_START).otherwise(0).bitwiseOR(F.when(F.col("is_end"), bits.BLOCK_END).otherwise(0))
    flags = flags.bitwiseOR(F.when(F.size(ranks) > 0, bits.HAS_RANKS).otherwise(0))
    return rows.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.col("node_id").cast("bigint").alias("node_id"),
        F.length(seq).alias("seq_len"),
        F.size(targets).alias("edge_count"),
        flags.cast("smallint").alias("flags"),
        dna.pack(seq, width).alias("sequence"),
        deltas(F.col("node_id"), F.transform(targets, bits.node_of)).alias("edges"),
        F.transform(targets, lambda t: bits.edge_orientation(t).cast("tinyint")).alias("edge_orientations"),
        optional("contig_id", F.lit(-1)).cast("int").alias("contig_id"),
        optional("position", F.lit(-1)).cast("bigint").alias("position"),
        ranks.alias("rank_offsets"),
        optional("edge_support", F.array().cast("array<int>")).cast("array<int>").alias("edge_support"),
        F.lit(width).cast("tinyint").alias("bits"),
        F.col("range_id").cast("bigint").alias("range_id"),
    )


def write(rows: DataFrame, path: str, bits_a_base: int | None = None) -> None:
    dealt = encode(rows, bits_a_base).repartitionByRange("range_id", "ord").sortWithinPartitions("range_id", "ord")
    dealt.write.partitionBy("range_id").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns, edges as node ids again and the label as text in seq."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.withColumn("edges", undelta(F.col("node_id"), F.col("edges"))).withColumn("seq", F.when(F.col("bits") == 3, dna.unpack(F.col("sequence"), F.col("seq_len"), 3)).otherwise(dna.unpack(F.col("sequence"), F.col("seq_len")))).drop("sequence")


def summary(rows: DataFrame) -> DataFrame:
    """Totals of block rows: records, blocks, bases, edges."""
    starts = F.count_if(bits.has(F.col("flags"), bits.BLOCK_START))
    return rows.agg(F.count("*").alias("records"), starts.alias("blocks"), F.coalesce(F.sum("seq_len"), F.lit(0)).alias("bases"), F.coalesce(F.sum("edge_count"), F.lit(0)).alias("edges"))


def paths_of_edge(ranks: Column, runs: Column, edge: Column) -> Column:
    """Paths that take an edge: the lengths of its runs, from the running sums and the runs' outranks. With one
    run an edge, in order, it is the difference of two neighbours."""
    own = F.transform(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: F.when(F.get(runs, i) == edge, F.get(ranks, i + 1) - F.get(ranks, i)).otherwise(0))
    return F.when(F.size(runs) > 0, F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(0)
