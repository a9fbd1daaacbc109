"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window sends all rows of a key to one task. Here the order is cut into
``bucket`` values (a column that never decreases along the order, such as the
hour of a timestamp or ``id div 1000000``). Rows are scanned inside
(key, bucket); one summary row per (key, bucket) carries the state from bucket
to bucket and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lorehouse.session import cut_lineage


def id_bucket(column: Column, rows: int = 1_000_000) -> Column:
    """Order bucket of a numeric id."""
    return F.floor(column / rows)


def hour_bucket(column: Column) -> Column:
    """Order bucket of a timestamp."""
    return F.date_trunc("hour", column)


def _keyed(rows: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Add ``_bucket`` and ``_key``, one value for (keys, bucket).

    NULL fields of a struct compare as equal, so the window over ``_key`` and
    the join back on it share one hash partitioning, and rows move once.
    """
    bucketed = rows.withColumn("_bucket", bucket)
    return bucketed.withColumn("_key", F.struct(*keys, "_bucket"))


def _across(keys: list[str]) -> WindowSpec:
    """The buckets of a key in order, over one row per bucket."""
    return Window.partitionBy(F.struct(*[F.col("_key")[k] for k in keys])).orderBy(F.col("_key")["_bucket"])


def running_total(
    rows: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    marked = _keyed(rows, keys, bucket).withColumn("_value", value)
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.sum("_value").over(inside))
    totals = marked.groupBy("_key").agg(F.sum("_value").alias("_total"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_key", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (
        local.join(carried, "_key", "left")
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_key", "_bucket", "_value", "_local", "_before")
    )


def row_number(
    rows: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str
) -> DataFrame:
    """1-based position per key."""
    return running_total(rows, keys, order, bucket, F.lit(1).cast("bigint"), out)


def neighbour(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: Column,
    out: str,
    step: int = -1,
) -> DataFrame:
    """Value of the previous (``step=-1``) or next (``step=1``) row of the key."""
    if step not in (-1, 1):
        raise ValueError("step is -1 or 1")
    marked = _keyed(rows, keys, bucket).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy("_key").orderBy(*order)
    shift = F.lag if step < 0 else F.lead
    local = marked.withColumn("_local", shift("_value").over(inside))
    # the edge row of a bucket: its last one for lag, its first one for lead
    edge = F.max_by if step < 0 else F.min_by
    edges = marked.groupBy("_key").agg(edge("_value", F.struct(*[F.col(c) for c in order])).alias("_edge"))
    carried = edges.select("_key", shift("_edge").over(_across(keys)).alias("_outside"))
    return (
        local.join(carried, "_key", "left")
        .withColumn(out, F.coalesce("_local", "_outside")["v"])
        .drop("_key", "_bucket", "_value", "_local", "_outside")
    )


def dense_ids(rows: DataFrame, order: list[str], out: str, start: int | Column = 1) -> DataFrame:
    """Consecutive ids in the order of unique columns, without a one-task window.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before (one row per partition).
    """
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # written once: the partition numbers must not change when a task is run again
    placed = cut_lineage(placed, "ranged")
    inside = Window.partitionBy("_part").orderBy(*order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    numbered = placed.withColumn("_n", F.row_number().over(inside))
    start = F.lit(start) if isinstance(start, int) else start
    return (
        numbered.join(shifts, numbered["_part"] == shifts["_p"])
        .withColumn(out, (F.col("_n") + F.col("_shift") + start - 1).cast("bigint"))
        .drop("_part", "_p", "_n", "_shift")
    )
