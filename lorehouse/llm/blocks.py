"""Blocks: contiguous ranges of a key, one shuffle partition each, and other helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "_block"
BLOCK_BYTES = 8 << 20
#: The driver holds one bound per block; a table of more blocks than this gets larger ones.
MAX_BLOCKS = 200_000
#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def _between(key: Column, bounds: list) -> Column:
    """Number of the range that holds ``key``; two steps of sqrt(n) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    tops = [bounds[i] for i in range(step - 1, len(bounds), step)]
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] + [[]]
    top = F.size(F.filter(F.lit(tops), lambda b: b < key)) if tops else F.lit(0)
    fine = F.array(*[F.lit(p) if p else F.array().cast("array<double>") for p in parts])
    inner = F.size(F.filter(F.get(fine, top), lambda b: b < key))
    return top * F.lit(step) + inner


def with_block(df: DataFrame, key: str, block_bytes: int = BLOCK_BYTES, text: str = "text") -> tuple[DataFrame, int]:
    """Add ``_block``: ranges of ascending ``key`` (nulls first) with about ``block_bytes`` of text each.

    Equal keys share a block. The bounds are quantiles of the key, so a few
    numbers per block reach the driver; at 100 TB a block has about 500 MB.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("binary")) + 64)).first()[0] or 0
    n = min(max(1, -(-size // block_bytes)), MAX_BLOCKS)
    cuts = [i / n for i in range(1, n)]
    bounds = df.approxQuantile(key, cuts, 1 / (8 * n)) if cuts else []
    bounds = sorted(set(bounds or []))
    block = F.coalesce(_between(F.col(key).cast("double"), bounds), F.lit(0)).cast("int")
    return df.withColumn(BLOCK, block), len(bounds) + 1


def in_blocks(df: DataFrame, n: int) -> DataFrame:
    """Move every block into the partition of its number."""
    return df.repartitionById(n, F.col(BLOCK).cast("int"))


def running_base(sizes: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sum over a table with one row per block."""
    from pyspark.sql.window import Window

    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches, column by column."""
    return chain.from_iterable(zip(*[b.column(n).to_pylist() for n in names], strict=True) for b in batches)
