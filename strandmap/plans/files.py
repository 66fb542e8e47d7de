"""Queries of the GFA reader, the container and the block rows made from them, with their SQL. The graph: of every
fortieth order whose parts are all different a walk; its text is written to the shared folder, once a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, dna
from ..operators import walks
from ..operators.storage import new_path
from ..sources import block_rows as rows_sink
from ..sources import container, gfa
from . import tables as t
from .registry import query
from .tables import W1

LETTERS = "ACGTNACGTNACGTNA"
_made: dict[tuple[str, str], tuple[str, str, gfa.Graph]] = {}


def text_of(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the graph: segments by part, then links; one leads nowhere."""
    w = t.part_walks(spark, d).where("path_id % 40 = 0")
    plain = w.groupBy("path_id").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("m")).where("n = m and n > 1").select("path_id")
    w = w.join(plain, "path_id")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    label = F.translate(F.md5(F.col("node_id").cast("string")), "0123456789abcdef", LETTERS)
    s = walks.nodes(w).orderBy("node_id").select(F.concat_ws("\t", F.lit("S"), name("node_id"), label, F.lit("SN:Z:chrT")).alias("value"))
    links = walks.steps(w).select(F.concat_ws("\t", F.lit("L"), name("from_node"), F.lit("+"), name("to_node"), F.lit("+"), F.lit("0M"), F.concat(F.lit("SR:i:"), F.col("path_id").cast("string"))).alias("value"))
    lost = spark.range(1).select(F.lit("L\tp1\t+\tnowhere\t+\t0M\tSR:i:1").alias("value"))
    return s.unionAll(links).unionAll(lost)


def made(spark: SparkSession, d: str) -> tuple[str, str, gfa.Graph]:
    """The text's folder, the container and the imported graph."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        base = new_path(spark, "graph")
        text_of(spark, d).coalesce(1).write.text(f"{base}/text")
        g = gfa.Graph(spark, f"{base}/text")
        path = f"{base}/graph.bin"
        g.write_container(path)
        _made[key] = (f"{base}/text/part-*", path, g)
    return _made[key]


def module(spark: SparkSession, d: str, name: str) -> DataFrame:
    return container.read(spark, made(spark, d)[1], name)


GRAPH = f"""{W1}, k AS (SELECT path_id FROM w WHERE path_id % 40 = 0 GROUP BY 1 HAVING count(*) = count(DISTINCT node_id) AND count(*) > 1),
    s AS (SELECT part, row_number() OVER (ORDER BY part) AS node_id, translate(md5(CAST(part AS VARCHAR)), '0123456789abcdef', '{LETTERS}') AS seq FROM (SELECT DISTINCT node_id AS part FROM w JOIN k USING (path_id))),
    x AS (SELECT path_id, step, s.node_id, lead(s.node_id) OVER (PARTITION BY path_id ORDER BY step) AS to_node FROM w JOIN k USING (path_id) JOIN s ON part = w.node_id),
    h AS (SELECT path_id, dense_rank() OVER (ORDER BY path_id) - 1 AS number, max(step) AS n FROM x GROUP BY 1),
    y AS (SELECT 2 * number AS path, step, 2 * node_id AS node FROM x JOIN h USING (path_id) UNION ALL SELECT 2 * number + 1, n + 1 - step, 2 * node_id + 1 FROM x JOIN h USING (path_id)),
    z AS (SELECT path, step, node, coalesce(lead(node) OVER (PARTITION BY path ORDER BY step), 0) AS to_node FROM y UNION ALL SELECT path, 0, 0, node FROM y WHERE step = 1)"""


@query(f"WITH {GRAPH} SELECT 'p' || part AS id, node_id, seq, 'chrT' AS contig FROM s")
def gfa_segments(spark, d):
    return made(spark, d)[2].nodes.select("id", "node_id", F.col("sequence").alias("seq"), F.try_element_at("tags", F.lit("SN")).alias("contig"))


@query(f"WITH {GRAPH} SELECT path_id AS walk, 2 * node_id AS from_node, 2 * to_node AS to_node FROM x WHERE to_node IS NOT NULL")
def gfa_links(spark, d):
    return made(spark, d)[2].links.select("walk", "from_node", "to_node")


@query(f"WITH {GRAPH} SELECT path_id AS walk, step, 2 * node_id AS node_id FROM x")
def gfa_walks(spark, d):
    return made(spark, d)[2].walks


@query("SELECT 'container' AS module, NULL::BOOLEAN AS simple, NULL::BOOLEAN AS metadata, NULL::BOOLEAN AS bidirectional, NULL::BOOLEAN AS translation, NULL::BOOLEAN AS zstd UNION ALL SELECT 'index', true, true, true, NULL, NULL UNION ALL SELECT 'metadata', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'graph', NULL, NULL, NULL, true, false")
def container_predicates(spark, d):
    return container.predicates(module(spark, d, "headers"))


@query(
    f"""WITH {GRAPH}, c AS (SELECT (SELECT count(*) FROM s) AS nodes, (SELECT count(*) FROM h) AS paths, (SELECT count(*) FROM z) AS visits)
    SELECT 'container' AS module, 'container v1, ' AS text UNION ALL SELECT 'index', printf('index v5, alphabet=%,d, offset=1, sequences=%,d, size=%,d', 2 * nodes + 2, 2 * paths, visits) FROM c
    UNION ALL SELECT 'metadata', printf('metadata v2, contigs=1, haplotypes=%,d, samples=1', paths) FROM c UNION ALL SELECT 'graph', printf('graph v3, nodes=%,d', nodes) FROM c"""
)
def container_headers(spark, d):
    return container.described(module(spark, d, "headers"))


@query("SELECT 'container' AS module, 'source' AS key, 'GFA' AS value")
def container_tags(spark, d):
    return module(spark, d, "tags")


@query(f"WITH {GRAPH} SELECT number AS path_id, 0 AS sample, 0 AS contig, path_id AS phase, 0 AS fragment, 'GFA_SAMPLE' AS sample_name, 'chrT' AS contig_name FROM h")
def container_paths(spark, d):
    paths, samples, contigs = (module(spark, d, m) for m in ("paths", "samples", "contigs"))
    rows = paths.join(samples.select(F.col("id").alias("sample"), F.col("name").alias("sample_name")), "sample").join(contigs.select(F.col("id").alias("contig"), F.col("name").alias("contig_name")), "contig")
    return rows.select("path_id", F.col("sample").cast("int").alias("sample"), F.col("contig").cast("int").alias("contig"), "phase", F.col("fragment").cast("int").alias("fragment"), "sample_name", "contig_name")


@query(f"WITH {GRAPH} SELECT CAST(node_id - 1 AS BIGINT) AS segment_id, 'p' || part AS name, node_id AS start_node FROM s")
def container_segments(spark, d):
    return module(spark, d, "segments")


@query(f"WITH {GRAPH} SELECT node_id, seq FROM s")
def container_sequences(spark, d):
    return module(spark, d, "sequences")


@query(f"WITH {GRAPH} SELECT node_id, 3 AS bits, 4 AS words, 32 AS length, seq, left(seq, 1) AS first_base FROM s")
def container_packed(spark, d):
    """Labels read as words, without strings; unpacked here to compare."""
    w, n = F.col("words"), F.col("length")
    return module(spark, d, "packed").select("node_id", "bits", F.size("words").alias("words"), "length", dna.unpack(w, n, 3).alias("seq"), dna.base_at(w, F.lit(0), 3).alias("first_base"))


@query(f"WITH {GRAPH}, e AS (SELECT node, to_node, count(*) AS support FROM z GROUP BY ALL) SELECT greatest(node - 1, 0) AS record_id, row_number() OVER (PARTITION BY node ORDER BY to_node) - 1 AS outrank, to_node, support FROM e")
def container_edges(spark, d):
    """Edges of the compressed records and the paths by each, from their runs."""
    rows = container.edges(module(spark, d, "records"))
    return rows.select("record_id", "outrank", F.col("to").alias("to_node"), "support")


@query(f"WITH {GRAPH} SELECT greatest(node - 1, 0) AS record_id, count(*) AS paths, true AS valid FROM z GROUP BY node")
def container_records(spark, d):
    """The visits of each record and whether its bytes are used up exactly."""
    rows = module(spark, d, "records").select("record_id", codec.run_total(F.col("runs")).alias("paths"), codec.record_valid(F.col("data")).alias("valid"))
    return rows.where("paths > 0")


@query(f"WITH {GRAPH} SELECT least(1000, 2 * count(*) + 1) AS records, 0 AS broken FROM s")
def container_checked(spark, d):
    rows = container.broken(spark, made(spark, d)[1])
    return rows.select("records", F.col("broken").cast("int").alias("broken"))


@query(f"WITH {GRAPH} SELECT seq FROM s WHERE node_id = 5")
def container_lookup(spark, d):
    """One label, read from its bytes alone."""
    return container.read(spark, made(spark, d)[1], "sequences", first=4, last=4).select("seq")


@query(
    f"""WITH {GRAPH}, e AS (SELECT node_id, to_node, count(*) AS support FROM x WHERE to_node IS NOT NULL GROUP BY ALL),
    g AS (SELECT node_id, count(*) AS edge_count, string_agg(to_node, ',' ORDER BY to_node) AS edges, string_agg(support, ',' ORDER BY to_node) AS support, CAST(sum(support) AS BIGINT) AS paths FROM e GROUP BY 1)
    SELECT node_id, seq, coalesce(edge_count, 0) AS edge_count, coalesce(edges, '') AS edges, coalesce(support, '') AS support, coalesce(paths, 0) AS paths, CASE WHEN paths > 0 THEN 32 ELSE 0 END AS ranked FROM s LEFT JOIN g USING (node_id)"""
)
def gfa_block_rows(spark, d):
    """The text graph decomposed, written as block rows and read back."""
    path = new_path(spark, "block-rows")
    made(spark, d)[2].write_block_rows(path)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = rows_sink.read(spark, path)
    paths = F.when(F.size("rank_offsets") > 0, F.element_at("rank_offsets", -1)).otherwise(0).cast("bigint")
    return rows.select("node_id", "seq", F.col("edge_count").cast("bigint").alias("edge_count"), joined("edges").alias("edges"), joined("edge_support").alias("support"), paths.alias("paths"), F.col("flags").bitwiseAND(32).cast("int").alias("ranked"))


@query(f"WITH {GRAPH}, e AS (SELECT DISTINCT node_id, to_node FROM x WHERE to_node IS NOT NULL) SELECT (SELECT count(*) FROM s) AS records, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM s) AS bases, (SELECT count(*) FROM e) AS edges")
def run_summary(spark, d):
    """Totals of the block rows."""
    path = new_path(spark, "block-rows")
    made(spark, d)[2].write_block_rows(path)
    return rows_sink.summary(rows_sink.read(spark, path)).select("records", "bases", "edges")
