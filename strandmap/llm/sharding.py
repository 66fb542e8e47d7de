"""Sharding by extendible hashing.

Documents are hashed by doc_id and text. The directory starts with one bucket; a bucket whose
documents exceed the byte limit splits on the next bit of the hash, others stay, until every shard
fits. Splits are decided on sizes summed by hash prefix, STEP bits at a time; only the prefixes of
buckets that are still too large after that are summed anew on STEP more bits, up to 60.

A document longer than the limit has a shard to itself. Rows that are equal in doc_id and text have one
hash, which no bit splits: such a bucket is cut into pages within the limit, by the rows' numbers within
their partition of the table and a running count over partitions, so that no task holds them all.

``write`` carries each row to its shard's folder with all its columns (none may be named like SHARD); rows are never
joined by doc_id, so null and repeated ids do no harm. The table must give the same partitions when it is read
again. ``read`` tells rows and shards from the files. Null texts have no bytes; null doc_ids hash like a value.
Empty tables give no rows; ``assign`` ignores extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialize

LIMIT, STEP, DEEPEST = 1 << 20, 12, 60
#: Bytes of text that a task writes, about.
TASK = 32 << 20


def hash_of() -> F.Column:
    """60 bits of the MD5 of doc_id and text, as a number; equal in other SQL engines."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, bucket, shard_bytes) of all shards; sizes has h and bytes, any number of rows a hash."""
    found = None
    # buckets that are too large at depth `base`; at first the one bucket of depth 0
    todo = sizes.select("h", "bytes")
    for base in range(0, DEEPEST, STEP):
        fine = materialize(todo.groupBy(F.shiftright("h", DEEPEST - base - STEP).alias("p")).agg(F.sum("bytes").alias("bytes")), "directory")
        levels = fine.select("p", "bytes", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("d")).groupBy("d", F.expr(f"shiftright(p, {STEP} - d)").alias("bucket")).agg(F.sum("bytes").alias("bytes"))
        levels = materialize(levels, "levels")
        # a bucket exists if its parent was too large; it is a shard if it is not
        fits = (F.col("bytes") <= limit) if base + STEP < DEEPEST else (F.col("bytes") <= limit) | (F.col("d") == STEP)
        large = levels.where(F.col("bytes") > limit).select((F.col("d") + 1).alias("d"), F.col("bucket").alias("parent"))
        shards = levels.where(fits).withColumn("parent", F.shiftright("bucket", 1))
        leaves = shards.join(large, ["d", "parent"], "left_semi")
        leaves = leaves.unionByName(shards.where("d = 0")) if base == 0 else leaves
        leaves = leaves.select((F.col("d") + base).alias("depth"), "bucket", F.col("bytes").alias("shard_bytes"))
        found = leaves if found is None else found.union(leaves)
        still = levels.where((F.col("d") == STEP) & (F.col("bytes") > limit)).select(F.col("bucket").alias("p"))
        if base + STEP >= DEEPEST or still.isEmpty():
            return found
        todo = todo.join(still, F.shiftright("h", DEEPEST - base - STEP) == still["p"], "left_semi")
    return found


def place(rows: DataFrame, shards: DataFrame, limit: int) -> DataFrame:
    """rows (with _h and _bytes) and their _depth, _bucket, _page and _shard_bytes."""
    names = rows.columns
    found = shards.agg(F.collect_set("depth"), F.count_if((F.col("depth") == DEEPEST) & (F.col("shard_bytes") > limit))).first()
    shards = shards.select(F.col("depth").alias("_depth"), F.col("bucket").alias("_bucket"), F.col("shard_bytes").alias("_shard_bytes"))
    # a hash belongs to the one depth at which its prefix is a shard; there are 61 depths at most
    choices = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("_h", DEEPEST - d).alias("bucket")) for d in sorted(found[0]) or [0]])
    hit = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.explode(choices)).withColumn("_depth", F.col("_at.depth")).withColumn("_bucket", F.col("_at.bucket")).drop("_at")
    hit = hit.join(shards, ["_depth", "_bucket"])
    none = F.lit(0).cast("bigint")
    out = [*names, "_depth", "_bucket", "_page", "_shard_bytes"]
    if not found[1]:
        return hit.withColumn("_page", none).select(*out)
    # pages only in buckets that no bit could split; rows of a bucket have one hash
    whole = (F.col("_depth") < DEEPEST) | (F.col("_shard_bytes") <= limit)
    deep = hit.where(~whole)
    counts = deep.groupBy("_h", "_part").agg(F.count("*").alias("_n"), F.max("_bytes").alias("_most"))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("_h", "_part", F.coalesce(F.sum("_n").over(before), none).alias("_before"), F.max("_most").over(Window.partitionBy("_h")).alias("_most")), "pages")
    number = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("doc_id")) - 1
    paged = deep.withColumn("_row", number).join(counts, ["_h", "_part"]).withColumn("_page", F.floor((F.col("_before") + F.col("_row")) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_most")))).cast("bigint"))
    return hit.where(whole).withColumn("_page", none).select(*out).unionByName(paged.select(*out))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_h", hash_of()).withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))


RESULT = ("depth", "bucket", "page", "shard_bytes")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, bucket (the first depth bits of the hash),
    page, shard_bytes (bytes of the bucket)."""
    rows = materialize(hashed(docs.select("doc_id", "text")).drop("text"), "hashes")
    shards = materialize(directory(rows.select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes")), limit), "shards")
    return place(rows, shards, limit).select("doc_id", F.col("_bytes").alias("n_bytes"), *(F.col(f"_{c}").alias(c) for c in RESULT))


SHARD = "_strandmap_shard"


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents as Parquet, one folder per shard, named by depth, bucket and page; all rows and columns kept."""
    sizes = materialize(hashed(docs.select("doc_id", "text")).select(F.col("_h").alias("h"), F.col("_bytes").alias("bytes")), "hashes")
    shards = materialize(directory(sizes, limit), "shards")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    drop(sizes)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    name = F.concat_ws("-", "_depth", "_bucket", "_page").alias(SHARD)
    place(hashed(docs), shards, limit).select(*docs.columns, name).repartition(tasks, SHARD).write.partitionBy(SHARD).option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes, depth, bucket, page, shard_bytes of all documents, from the shards' files."""
    files = spark.read.schema(f"doc_id bigint, text string, {SHARD} string").parquet(path)
    at = F.split(SHARD, "-")
    rows = files.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), at[0].cast("int").alias("depth"), at[1].cast("bigint").alias("bucket"), at[2].cast("bigint").alias("page"))
    rows = materialize(rows, "shard-rows")
    return rows.join(rows.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("shard_bytes")), ["depth", "bucket"]).select("doc_id", "n_bytes", *RESULT)
