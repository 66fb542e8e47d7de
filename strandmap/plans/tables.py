"""The driver's tables read as walks, nodes and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.walks import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1: an order visits the parts of its lines."""
    return numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], F.col("l_partkey") + 1)


def event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2: a user visits event types."""
    return numbered(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("event_type"))


def role_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3: a conversation visits roles."""
    return numbered(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role"))


def order_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4: a customer visits its orders; each order is one node."""
    return numbered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderkey"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", dna.clean(F.coalesce("text", F.lit(""))).alias("seq"))


def segment_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments begin at urgent orders."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("start_node"), F.col("o_orderstatus").alias("name"))


#: The same for DuckDB, as parts of a WITH clause.
W1 = "w AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS step, l_partkey + 1 AS node_id FROM lineitem)"
W2 = "w AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_type AS node_id FROM events)"
W3 = "w AS (SELECT conv_id AS path_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, role AS node_id FROM conversations)"
W4 = "w AS (SELECT o_custkey AS path_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderkey AS node_id FROM orders)"
STEPS = "s AS (SELECT * FROM (SELECT path_id, step, node_id AS from_node, lead(node_id) OVER (PARTITION BY path_id ORDER BY step) AS to_node FROM w) WHERE to_node IS NOT NULL)"
SUPPORT = "e AS (SELECT from_node, to_node, count(*) AS support FROM s GROUP BY ALL)"
SEQ = "q AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)"
SEGMENTS = "g AS (SELECT o_orderkey AS start_node, o_orderstatus AS name FROM orders WHERE o_orderpriority = '1-URGENT')"
