"""Capture sessions and message routing over event tables (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import message_urls
from lorehouse.operators.ordered import hour_bucket, neighbour, running_total

ORDER = ["ts", "id"]


def _gap(minutes: int) -> Column:
    return F.make_dt_interval(mins=F.lit(minutes))


def session_outcome(texts: Column, documents: Column) -> Column:
    """What closing a session yields: a fact, documents only, or nothing."""
    return F.when(texts > 0, "saved").when(documents > 0, "documents").otherwise("empty")


def idle_segments(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Add ``segment``: it grows when more than ``minutes`` passed since the user's last event."""
    bucket = hour_bucket(F.col("ts"))
    before = neighbour(events, ["user_id"], ORDER, bucket, F.col("ts"), "_before")
    breaks = F.col("_before").isNull() | (F.col("ts") > F.col("_before") + _gap(minutes))
    marked = before.withColumn("_break", breaks.cast("bigint")).drop("_before")
    return running_total(marked, ["user_id"], ORDER, bucket, F.col("_break"), "segment").drop("_break")


def idle_sessions(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Sessions of a user's events separated by idle gaps: first, last, events."""
    return (
        idle_segments(events, minutes)
        .groupBy("user_id", "segment")
        .agg(
            F.min("ts").alias("first_at"),
            F.max("ts").alias("last_at"),
            F.count(F.lit(1)).alias("events"),
        )
    )


def toggle_states(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """State of every event under the toggle rule: segment, session, state.

    ``events``: user_id, ts, id, kind (toggle, text, document). An odd toggle
    opens, an even one closes; a gap of more than ``minutes`` closes before the
    next event. Every event of an open session renews it, so gaps between
    consecutive events decide.
    """
    segments = idle_segments(events, minutes)
    is_toggle = F.col("kind") == "toggle"
    counted = running_total(
        segments, ["user_id", "segment"], ORDER, hour_bucket(F.col("ts")),
        is_toggle.cast("bigint"), "_toggles",
    )
    is_open = F.col("_toggles") % 2 == 1
    state = (
        F.when(is_toggle & is_open, "opened")
        .when(is_toggle, "closed")
        .when(is_open & (F.col("kind") == "text"), "buffered")
        .when(is_open, "attached")
        .otherwise("outside")
    )
    session = F.when(is_toggle | is_open, F.ceil(F.col("_toggles") / 2))
    return counted.withColumn("session", session).withColumn("state", state).drop("_toggles")


def toggle_sessions(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Sessions of the toggle rule with their counts, ending and outcome.

    An idle session closes at the user's next event; without one it is still open.
    """
    states = toggle_states(events, minutes).filter(F.col("session").isNotNull())
    following = neighbour(
        events, ["user_id"], ORDER, hour_bucket(F.col("ts")), F.col("ts"), "next_at", step=1
    ).select("user_id", "id", "next_at")
    rows = states.join(following, ["user_id", "id"])
    texts = F.count_if(F.col("state") == "buffered")
    documents = F.count_if(F.col("state") == "attached")
    closed_at = F.max(F.when(F.col("state") == "closed", F.col("ts")))
    grouped = rows.groupBy("user_id", "segment", "session").agg(
        F.min("ts").alias("opened_at"),
        F.max("ts").alias("last_active_at"),
        texts.alias("texts"),
        documents.alias("documents"),
        closed_at.alias("_toggled"),
        F.max_by("next_at", F.struct(*ORDER)).alias("_contact"),
    )
    ending = (
        F.when(F.col("_toggled").isNotNull(), "toggle")
        .when(F.col("_contact").isNotNull(), "idle")
        .otherwise("open")
    )
    return (
        grouped.withColumn("ending", ending)
        .withColumn("closed_at", F.coalesce("_toggled", "_contact"))
        .withColumn(
            "outcome",
            F.when(ending != "open", session_outcome(F.col("texts"), F.col("documents"))),
        )
        .drop("_toggled", "_contact")
    )


def session_texts(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Buffered texts of toggle sessions with their sequence numbers."""
    kept = toggle_states(events, minutes).filter(F.col("state") == "buffered")
    keys = ["user_id", "segment", "session"]
    return running_total(
        kept, keys, ORDER, hour_bucket(F.col("ts")), F.lit(1).cast("bigint"), "seq"
    )


def message_kind(text: Column) -> Column:
    """A message of URLs only brings documents, any other is text."""
    return F.when(message_urls(text).isNotNull(), "document").otherwise("text")


def route_messages(events: DataFrame, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Label every message: page (URLs only), buffer (open session) or question.

    ``events``: user_id, ts, id, is_toggle, text.
    """
    kind = F.when(F.col("is_toggle"), "toggle").otherwise(message_kind(F.col("text")))
    states = toggle_states(events.withColumn("kind", kind), minutes)
    route = (
        F.when(F.col("kind") == "document", "page")
        .when(F.col("state") == "buffered", "buffer")
        .otherwise("question")
    )
    return states.filter(F.col("kind") != "toggle").withColumn("route", route)
