"""Candidates for all-of conditions through their rarest key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.session import cut_lineage

EVERYTHING = ""


def rarest_key(needs: DataFrame, postings: DataFrame, group: list[str]) -> DataFrame:
    """Choose for each group the required key with the fewest postings.

    ``needs``: group columns, key. ``postings``: key, item. A match must hold
    every key of its group, so the postings of one key contain all matches; the
    rarest one keeps frequent keys out of the join. Keys absent from the
    postings count zero and leave the group without candidates.
    """
    wanted = needs.select("key")
    counts = (
        postings.select("key").join(wanted, "key", "left_semi").groupBy("key").agg(
            F.count(F.lit(1)).alias("_n")
        )
    )
    counted = needs.join(counts, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return counted.groupBy(*group).agg(F.min_by("key", F.struct("_n", "key")).alias("key"))


def candidates(needs: DataFrame, postings: DataFrame, group: list[str]) -> DataFrame:
    """``(group…, item)`` pairs that hold the rarest key of the group.

    The small tables are written first: with their true sizes the planner
    broadcasts them while they fit and never shuffles all postings for a few
    questions. Beyond the bound the postings are shuffled once, filtered, and
    adaptive execution splits the partition of a frequent key.
    """
    needs = cut_lineage(needs, "needs")
    drivers = cut_lineage(rarest_key(needs, postings, group), "drivers")
    return postings.join(drivers, "key").select(*group, "item")
