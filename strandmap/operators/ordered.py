"""Ordered scans that a single task could not hold: running sums, neighbours and as-of values over a
whole table. Rows are cut into ranges of the order column; each range is scanned by itself, and what
goes over a range's edge is carried by a table with one row a range. That table is cut into blocks of ranges in
the same way, so that one task scans no more than a row for every width squared. Rows without an order value stay, add nothing
to the others and have no place (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, order: str, width: int) -> DataFrame:
    """df with _range; rows without an order value are dealt to ranges before all others, by their partition."""
    none = F.lit(-(1 << 62)) - F.spark_partition_id()
    return df.withColumn("_range", F.coalesce(F.floor(F.col(order) / width), none))


def placed(order: str, value: Column) -> Column:
    return F.when(F.col(order).isNotNull(), value)


def carried(edges: DataFrame, value: str, combine, width: int, after: bool = False) -> DataFrame:
    """(_range, _carry): value of all ranges before (or after) each one, combined by F.sum, F.min or F.max; null for none.
    Two levels: within blocks of width ranges, and over the blocks."""
    sign = -1 if after else 1
    rows = edges.withColumn("_at", sign * F.col("_range")).withColumn("_block", F.floor(F.col("_at") / width))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(combine(value).alias("_v")).select("_block", combine("_v").over(past(Window.orderBy("_block"))).alias("_outer"))
    rows = rows.join(blocks, "_block").withColumn("_inner", combine(value).over(past(Window.partitionBy("_block").orderBy("_at"))))
    both = F.coalesce(F.col("_outer") + F.col("_inner"), "_outer", "_inner") if combine is F.sum else (F.least if combine is F.min else F.greatest)("_outer", "_inner")
    return rows.select("_range", both.alias("_carry"))


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of value over all rows before and with each row. order must be unique."""
    rows = ranges(df.withColumn("_value", placed(order, value)), order, width)
    carry = carried(rows.groupBy("_range").agg(F.sum("_value").alias("_sum")), "_sum", F.sum, width)
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_carry", F.lit(0)) + F.sum("_value").over(within)
    return rows.join(carry, "_range", "left").withColumn(name, placed(order, total)).drop("_range", "_value", "_carry")


def running_sum_by(df: DataFrame, key: str, order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of value over the key's rows before and with each row: ranges within the key, so that a key that
    holds much of the table is many tasks. order must be unique within a key; rows without one stay apart."""
    rows = ranges(df.withColumn("_value", placed(order, value)), order, width)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(key, "_range").agg(F.sum("_value").alias("_sum")).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carry, rows[key].eqNullSafe(carry["_key"]) & (rows["_range"] == carry["_at"]), "left")
    return out.withColumn(name, placed(order, F.col("_carry") + F.sum("_value").over(within))).drop("_range", "_value", "_carry", "_key", "_at")


def number(df: DataFrame, order: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the place of each row, from 0. order must be unique."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name, width).withColumn(name, F.col(name) - 1)


def neighbour(df: DataFrame, order: str, name: str, after: bool = False, width: int = 4096) -> DataFrame:
    """Adds the order value of the row before (or after) each row, null at the end. order must be unique."""
    rows = ranges(df, order, width)
    edge = F.min if after else F.max
    carry = carried(rows.groupBy("_range").agg(edge(order).alias("_edge")), "_edge", edge, width, after)
    own = (F.lead if after else F.lag)(order).over(Window.partitionBy("_range").orderBy(order))
    return rows.join(carry, "_range", "left").withColumn(name, placed(order, F.coalesce(own, "_carry"))).drop("_range", "_carry")


def as_of(probes: DataFrame, starts: DataFrame, key: str, start: str, name: str, width: int = 4096) -> DataFrame:
    """Adds to each probe the last start at or before its key, null below the first."""
    found = starts.where(F.col(start).isNotNull()).select(F.col(start).alias(key), F.col(start).alias("_start"), F.lit(False).alias("_probe"))
    both = probes.withColumn("_start", F.lit(None).cast("bigint")).withColumn("_probe", F.lit(True)).unionByName(found, allowMissingColumns=True)
    rows = ranges(both, key, width)
    carry = carried(rows.groupBy("_range").agg(F.max("_start").alias("_max")), "_max", F.max, width)
    within = Window.partitionBy("_range").orderBy(key, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carry, "_range", "left").withColumn(name, placed(key, F.coalesce(F.last("_start", ignorenulls=True).over(within), "_carry")))
    return out.where("_probe").drop("_range", "_start", "_probe", "_carry")
