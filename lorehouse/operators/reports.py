"""Corpus, graph, cost, session and provenance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.jsonb import field_text, key_exists
from lorehouse.operators.filters import active


def _counted(rows: DataFrame, column: str, section: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit(section).alias("section"), "label", "n")


def _total(rows: DataFrame, section: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(section).alias("section"), F.lit(None).cast("string").alias("label"), "n"
    )


def corpus_stats(
    documents: DataFrame, entities: DataFrame, chunks: DataFrame, facts: DataFrame
) -> DataFrame:
    """``(section, label, n)``: documents by type and status, entities by type, totals."""
    # one scan counts both document breakdowns
    both = documents.select(
        F.explode(
            F.array(
                F.struct(F.lit("documents by type").alias("section"), F.col("doc_type").alias("label")),
                F.struct(
                    F.lit("documents by status").alias("section"), F.col("extraction_status").alias("label")
                ),
            )
        ).alias("row")
    ).groupBy("row.section", "row.label").agg(F.count(F.lit(1)).alias("n"))
    return (
        both.unionByName(_counted(entities, "entity_type", "entities by type"))
        .unionByName(_total(chunks, "chunks"))
        .unionByName(_total(active(facts), "active facts"))
    )


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(section, label, n)``: nodes by type and active edges by relation."""
    return _counted(entities, "entity_type", "nodes by type").unionByName(
        _counted(active(relations), "relation", "edges by relation")
    )


def edge_ends(relations: DataFrame) -> DataFrame:
    """One ``id`` row per end of each active edge."""
    return active(relations).select(F.explode(F.array("source_id", "target_id")).alias("id"))


def degree_top_k(entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """Entities with most active edges; parallel edges count, ties go by id."""
    degree = edge_ends(relations).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    described = degree.join(entities.select("id", "name", "entity_type"), "id")
    return described.orderBy(F.desc("degree"), "id").limit(k)


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without any active edge."""
    return entities.join(edge_ends(relations), "id", "left_anti")


def isolated_count(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Number of entities without any active edge."""
    return isolated(entities, relations).agg(F.count(F.lit(1)).alias("isolated"))


def _cost(usage: str = "usage") -> Column:
    return field_text(F.col(usage), "cost").try_cast("double")


def _billed(messages: DataFrame) -> DataFrame:
    return messages.filter(key_exists(F.col("usage"), "cost"))


def month_to_date_cost(messages: DataFrame, as_of: Column) -> DataFrame:
    """Cost of the calendar month so far; zero without messages."""
    recent = messages.filter(F.col("created_at") >= F.date_trunc("month", as_of))
    return _billed(recent).agg(F.coalesce(F.sum(_cost()), F.lit(0.0)).alias("cost"))


def budget_state(messages: DataFrame, as_of: Column, limit: float = fixed.MONTHLY_LIMIT) -> DataFrame:
    """Month cost and whether the spend limit is reached."""
    spent = month_to_date_cost(messages, as_of)
    return spent.withColumn("limited", F.col("cost") >= limit)


def cost_by_model(messages: DataFrame) -> DataFrame:
    """Cost and calls per model over all time; calls without a model form a group."""
    model = field_text(F.col("usage"), "model").alias("model")
    return (
        _billed(messages)
        .groupBy(model)
        .agg(F.sum(_cost()).alias("cost"), F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("cost"), "model")
    )


def cost_by_user(messages: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """Cost per user name; users of the same name are one line.

    Messages are summed per conversation before the joins.
    """
    summed = (
        _billed(messages)
        .groupBy(F.col("conversation_id"))
        .agg(F.sum(_cost()).alias("_cost"))
    )
    owners = conversations.select(F.col("id").alias("conversation_id"), "user_id")
    names = users.select(F.col("id").alias("user_id"), "name")
    return (
        summed.join(owners, "conversation_id")
        .join(names, "user_id")
        .groupBy("name")
        .agg(F.sum("_cost").alias("cost"))
        .orderBy(F.desc("cost"), "name")
    )


def usage_totals(messages: DataFrame) -> DataFrame:
    """Token and cost sums per conversation; missing numbers count zero."""
    usage = F.col("usage")

    def number(path: str) -> Column:
        return F.get_json_object(usage, path).try_cast("double")

    def whole(*paths: str) -> Column:
        # a zero falls through to the next key, as a missing value does
        found = [F.nullif(number(path), F.lit(0.0)) for path in paths]
        return F.coalesce(*found, F.lit(0.0)).cast("bigint")

    columns = {
        "prompt_tokens": whole("$.prompt_tokens"),
        "completion_tokens": whole("$.completion_tokens"),
        "total_tokens": whole("$.total_tokens"),
        "cached_tokens": whole("$.prompt_tokens_details.cached_tokens"),
        "cache_write_tokens": whole("$.cache_write_tokens", "$.cache_creation_input_tokens"),
        "cost": F.coalesce(number("$.cost"), F.lit(0.0)),
    }
    return messages.groupBy("conversation_id").agg(
        *[F.sum(value).alias(name) for name, value in columns.items()]
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


def session_report(
    sessions: DataFrame, users: DataFrame, buffered: DataFrame, documents: DataFrame
) -> DataFrame:
    """Active sessions with their numbers of buffered messages and attached documents."""
    messages = buffered.groupBy("session_id").agg(F.count(F.lit(1)).alias("_buffered"))
    attached = (
        documents.filter(F.col("ingest_session_id").isNotNull())
        .groupBy(F.col("ingest_session_id").alias("session_id"))
        .agg(F.count(F.lit(1)).alias("_docs"))
    )
    open_sessions = sessions.filter("active").select(
        F.col("id").alias("session_id"), "user_id", "started_at", "last_active_at"
    )
    return (
        open_sessions.join(users.select(F.col("id").alias("user_id"), "name"), "user_id")
        .join(messages, "session_id", "left")
        .join(attached, "session_id", "left")
        .select(
            "session_id",
            "name",
            "started_at",
            "last_active_at",
            F.coalesce("_buffered", F.lit(0)).alias("buffered"),
            F.coalesce("_docs", F.lit(0)).alias("docs"),
        )
        .orderBy("session_id")
    )


def list_facts(facts: DataFrame) -> DataFrame:
    """Active facts by topic."""
    return active(facts).select("topic", "content", "valid_from").orderBy("topic")


def fact_topics(facts: DataFrame) -> DataFrame:
    """Active topics with update time and content length."""
    return (
        active(facts)
        .select("topic", F.col("valid_from").alias("updated_at"), F.length("content").alias("length"))
        .orderBy("topic")
    )


def facts_block(facts: DataFrame, limit: int = fixed.FACTS_BLOCK_LIMIT) -> DataFrame:
    """``(block, truncated)``: active facts as text, cut at ``limit`` characters.

    Each line takes at least five characters, so no more than ``limit`` facts can
    show: only those, first by topic, are brought together. No facts: empty block.
    """
    live = active(facts)
    line = F.concat(F.lit("["), F.col("topic"), F.lit("]: "), F.col("content"))
    first = live.orderBy("topic").limit(limit + 1).select(
        "topic", F.left(line, F.lit(limit + 1)).alias("line")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("topic", "line"))), lambda r: r["line"])
    block = F.concat_ws("\n", F.lit(fixed.FACTS_HEADER), F.array_join(lines, "\n"))
    return (
        first.agg(F.when(F.count(F.lit(1)) > 0, block).otherwise("").alias("_block"))
        .select(
            F.left("_block", F.lit(limit)).alias("block"),
            (F.length("_block") > limit).alias("truncated"),
        )
    )


def close_buffer(buffered: DataFrame) -> DataFrame:
    """Text of each session: its messages in order, separated by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    text = F.array_join(F.transform(ordered, lambda m: m["text"]), fixed.BUFFER_JOIN)
    return buffered.groupBy("session_id").agg(text.alias("content"))


def last_activity(buffered: DataFrame, attached: DataFrame) -> DataFrame:
    """Latest message or attached document of each session."""
    return (
        buffered.select("session_id", "ts")
        .unionByName(attached.select("session_id", "ts"))
        .groupBy("session_id")
        .agg(F.max("ts").alias("last_active_at"))
    )


def trace_facts(facts: DataFrame, buffered: DataFrame, documents: DataFrame) -> DataFrame:
    """Where each fact version came from: one row per message and document of its session.

    A version without a session, or with an empty one, keeps a row of kind NULL.
    """
    versions = facts.select(
        F.col("id").alias("fact_id"), "topic", "valid_from", "created_by", "session_id"
    )
    messages = buffered.select(
        "session_id", F.lit("message").alias("kind"), F.col("seq").cast("bigint").alias("number"), "text"
    )
    attached = documents.filter(F.col("ingest_session_id").isNotNull()).select(
        F.col("ingest_session_id").alias("session_id"),
        F.lit("document").alias("kind"),
        F.col("id").cast("bigint").alias("number"),
        F.col("title").alias("text"),
    )
    return versions.join(messages.unionByName(attached), "session_id", "left")


def trace_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts born in the session each document was loaded in; NULL outside a session."""
    loaded = documents.select(
        F.col("id").alias("document_id"), "title", F.col("ingest_session_id").alias("session_id")
    )
    born = facts.select("session_id", F.col("id").alias("fact_id"), "topic", "valid_from")
    return loaded.join(born, "session_id", "left")
