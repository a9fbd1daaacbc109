"""Sharding through fixed virtual slots, with DataFrame operations only.

A record is hashed into one of thousands of slots once and for all; only the
small slot-to-shard map changes. The map is a versioned table: every rebalance
keeps what fits, moves the rest, and writes a new version beside the old ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse.llm.blocks import text_of
from lorehouse.session import cut_lineage, fresh_path

SLOTS = 8192
ROW_BYTES = 16
MAP = "version int, virtual_slot bigint, shard int"


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: by its key; a record without key goes by its text, so that many of them spread."""
    return F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(slots))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: slots dealt evenly, whatever they hold."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").alias("virtual_slot"), F.pmod(F.col("id"), F.lit(shards)).cast("int").alias("shard")
    )


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes per slot; partial sums per task, so a slot costs one row per task."""
    return records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with near equal bytes in ``shards`` shards.

    A shard keeps its slots, largest first, as long as they fit into the mean
    size; slots beyond it, and those of shards that no longer exist, are dealt
    one by one, largest first, to the shard with the fewest bytes. The map has a
    fixed number of rows, so this fold over it is of fixed size.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    held = (
        slot_map.join(sizes, "virtual_slot", "left")
        .select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
        .join(F.broadcast(total), how="inner")
    )
    down = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    stays = (F.sum("bytes").over(down) * shards <= F.col("_total")) & (F.col("shard") < shards)
    marked = held.withColumn("_stays", stays)
    state = marked.agg(
        F.max("version").alias("version"),
        F.array_sort(F.collect_list(F.when(~F.col("_stays"), F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("s"))))).alias("free"),
        F.collect_list(F.when(F.col("_stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("kept"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda k: F.aggregate(
            "kept", F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["shard"] == k, x["bytes"]).otherwise(F.lit(0))
        ),
    )
    none = F.array().cast("array<int>")
    dealt = F.aggregate(
        "free",
        F.struct(loads.alias("loads"), none.alias("to")),
        lambda acc, slot: F.struct(
            F.transform(
                acc["loads"],
                lambda load, k: load
                - F.when(k == F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1, slot["b"]).otherwise(F.lit(0)),
            ).alias("loads"),
            F.concat(
                acc["to"], F.array((F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int"))
            ).alias("to"),
        ),
    )["to"]
    moved = state.select("version", F.explode(F.arrays_zip(F.col("free.s").alias("s"), dealt.alias("to"))).alias("x"))
    stayed = state.select("version", F.explode("kept").alias("x"))
    return stayed.select((F.col("version") + 1).alias("version"), "x.virtual_slot", "x.shard").unionByName(
        moved.select((F.col("version") + 1).alias("version"), F.col("x.s").alias("virtual_slot"), F.col("x.to").alias("shard"))
    )


def records_of(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row; texts are read once and not shuffled."""
    raw = text_of().cast("binary")
    return documents.select(
        "doc_id",
        (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add the shard and the place in it (gapless from 0): the rows of the slots before, plus the place in the slot.

    A window holds one slot of one shard, not a shard; the offsets come from one row per slot.
    """
    sizes = slot_sizes(records)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        slot_map.join(sizes, "virtual_slot")
        .withColumn("_base", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .select("virtual_slot", "shard", "_base")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(bases), "virtual_slot")
        .withColumn("slot", (F.col("_base") + F.col("_place") - 1).cast("bigint"))
        .drop("_base", "_place")
    )


def stored_map(spark: SparkSession, folder: str) -> DataFrame | None:
    """All versions of the map in ``folder``, or None where there is none yet."""
    try:
        return spark.read.schema(MAP).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(versions: DataFrame) -> DataFrame:
    """The map of the highest version."""
    return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version")


def edit_map(sizes: DataFrame, folder: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Append the next version to the map in ``folder`` and give all versions.

    The newest stored version is rebalanced; a folder without a map starts with
    version 0. A version is one file, there as a whole or not at all. A map of
    another number of slots is refused, as its slots hold other records.
    """
    spark = sizes.sparkSession
    versions = stored_map(spark, folder)
    if versions is None:
        first_map(spark, shards, slots).coalesce(1).write.mode("append").parquet(folder)
        versions = spark.read.schema(MAP).parquet(folder)
    now = cut_lineage(newest(versions), "slot-map")
    if now.count() != slots:
        raise ValueError(f"the map in {folder} does not have {slots} slots")
    rebalanced(now, sizes, shards).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(MAP).parquet(folder)


def shard_documents(
    documents: DataFrame, shards: int = 40, slots: int = SLOTS, map_folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """All documents with shard and place, and the versioned map that put them there.

    ``map_folder`` holds the map of earlier runs, which is edited: slots that still
    fit stay where they are. Without it a new map is begun in the shared folder.
    Sizes of the shards are near equal (law ``bytes``); a hot slot cannot arise
    from equal texts, as slots go by doc_id. A null text has no bytes; a null
    doc_id goes by its text; repeated rows take places one after the other. An
    empty table gives no rows. Other columns are left out: the caller joins or
    writes what it needs by ``shard``.
    """
    spark = documents.sparkSession
    records = cut_lineage(records_of(documents, slots), "records")
    versions = edit_map(slot_sizes(records), map_folder or fresh_path(spark, "slot-map"), shards, slots)
    return place(records, newest(versions).select("virtual_slot", "shard")), versions


def shard_digest(documents: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document with its shard."""
    placed, _ = shard_documents(documents, shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
