"""Topics for new facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.embedding import embed
from lorehouse.functions.text import slugify_topic
from lorehouse.operators.filters import active
from lorehouse.operators.vector_search import cosine_top_k
from lorehouse.operators.versions import upsert_facts


def assign_topics(
    contents: DataFrame,
    active_facts: DataFrame,
    *,
    threshold: float = fixed.TOPIC_SIMILARITY,
    dim: int = fixed.EMBED_DIM,
) -> DataFrame:
    """Add ``topic``: that of the nearest active fact above the threshold, else a slug.

    ``contents``: content_id, content. ``active_facts``: topic, content. Equal
    scores go to the first topic in order.
    """
    queries = embed(contents.select(F.col("content_id").alias("query_id"), "content"), "content", dim=dim)
    items = embed(active_facts.select(F.col("topic").alias("item_id"), "content"), "content", dim=dim)
    nearest = cosine_top_k(queries, items, 1, above=threshold).select(
        F.col("query_id").alias("content_id"), F.col("item_id").alias("_near")
    )
    return (
        contents.join(nearest, "content_id", "left")
        .withColumn("topic", F.coalesce("_near", slugify_topic(F.col("content"))))
        .drop("_near")
    )


def close_to_facts(closed: DataFrame, facts: DataFrame, **limits: float | int) -> DataFrame:
    """Fact table after the texts of closed sessions: each becomes a version of its topic.

    ``closed``: id (of the new version), content, valid_from (the closing time).
    Topics are chosen against the facts active before the batch; further columns
    of ``facts`` are NULL in the new versions.
    """
    texts = closed.select(F.col("id").alias("content_id"), "content")
    topics = assign_topics(texts, active(facts).select("topic", "content"), **limits).select(F.col("content_id").alias("id"), "topic")
    new = closed.select("id", "content", "valid_from").join(topics, "id")
    rest = [f for f in facts.schema if f.name not in (*new.columns, "invalid_at")]
    new = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest}) if rest else new
    return upsert_facts(facts, new.select(*[c for c in facts.columns if c != "invalid_at"]))
