"""Per-key histories: recent messages, sequence numbers, active rows, fact versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse import fixed_values as fixed
from lorehouse.operators.ordered import (
    hour_bucket,
    id_bucket,
    neighbour,
    row_number,
    running_total,
)


def last_messages(messages: DataFrame, limit: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """Last ``limit`` messages of each conversation; ``place`` counts up in time order.

    The limit prunes rows before the shuffle, so a long conversation costs no
    more than a short one.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    recent = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    oldest = Window.partitionBy("conversation_id").orderBy("id")
    return recent.withColumn("place", F.row_number().over(oldest)).drop("_n")


def assign_seq(arrivals: DataFrame, buffered: DataFrame, order: str = "id") -> DataFrame:
    """Number new texts of each session after the highest number already used."""
    top = buffered.groupBy("session_id").agg(F.max("seq").alias("_top"))
    numbered = row_number(arrivals, ["session_id"], [order], id_bucket(F.col(order)), "_n")
    return (
        numbered.join(top, "session_id", "left")
        .withColumn("seq", F.col("_n") + F.coalesce("_top", F.lit(0)))
        .drop("_n", "_top")
    )


def keep_newest_active(conversations: DataFrame) -> DataFrame:
    """Only the newest of a user's active conversations stays active."""
    newest = (
        conversations.filter("active").groupBy("user_id").agg(F.max("id").alias("_newest"))
    )
    return (
        conversations.join(newest, "user_id", "left")
        .withColumn("active", F.col("active") & (F.col("id") == F.col("_newest")))
        .drop("_newest")
        .select(*conversations.columns)
    )


def fact_history(facts: DataFrame) -> DataFrame:
    """Versions of every topic, numbered oldest first, with the end of their validity."""
    bucket = hour_bucket(F.col("valid_from"))
    order = ["valid_from", "id"]
    numbered = row_number(facts, ["topic"], order, bucket, "number")
    following = neighbour(numbered, ["topic"], order, bucket, F.col("valid_from"), "_next", step=1)
    return following.withColumn("until", F.coalesce("invalid_at", "_next")).drop("_next")


def conversation_segments(messages: DataFrame, is_reset: Column) -> DataFrame:
    """Conversation number per user: a reset closes one, the next message opens another.

    Reset rows themselves belong to no conversation and are dropped.
    """
    counted = running_total(
        messages.withColumn("_reset", is_reset),
        ["user_id"],
        ["ts", "id"],
        hour_bucket(F.col("ts")),
        F.col("_reset").cast("bigint"),
        "_resets",
    )
    talk = counted.filter(~F.col("_reset"))
    # several resets in a row open nothing: number the segments that hold messages
    used = talk.select("user_id", "_resets").distinct()
    numbers = row_number(used, ["user_id"], ["_resets"], id_bucket(F.col("_resets")), "segment")
    return talk.join(numbers, ["user_id", "_resets"]).drop("_reset", "_resets")
