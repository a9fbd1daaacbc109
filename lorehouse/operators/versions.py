"""Versioned documents and bitemporal tables; every function returns the new table state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import canonical_name, content_hash
from lorehouse.operators.filters import active
from lorehouse.operators.links import resolve_links, resolve_pending
from lorehouse.operators.ordered import dense_ids, hour_bucket, id_bucket, neighbour, running_total
from lorehouse.sources.urls import canonical_url

MENTION = ["entity_id", "document_id", "role"]
RELATION = ["source_id", "target_id", "relation", "document_id"]
LINK = ["source_id", "target_id", "kind"]


# --- documents ------------------------------------------------------------------


def plan_ingest(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Add content_hash, id, version and action (created, updated, unchanged).

    ``incoming``: one row per source_path with its text. ``current``: id,
    source_path, content_hash, version. The texts stay out of the join keys.
    """
    known = current.select(
        "source_path",
        "id",
        F.col("content_hash").alias("_old_hash"),
        F.col("version").alias("_old_version"),
    )
    same = F.col("content_hash") == F.col("_old_hash")
    action = (
        F.when(F.col("id").isNull(), "created").when(same, "unchanged").otherwise("updated")
    )
    version = F.coalesce(F.col("_old_version"), F.lit(0)) + F.when(
        F.col("action") == "unchanged", 0
    ).otherwise(1)
    return (
        incoming.withColumn("content_hash", content_hash(F.col("text")))
        .join(known, "source_path", "left")
        .withColumn("action", action)
        .withColumn("version", version)
        .drop("_old_hash", "_old_version")
    )


def fold_versions(loads: DataFrame, seq: str = "seq") -> DataFrame:
    """Version chain of several loads of the same sources: source_path, seq, hash, version, action.

    A load equal to the one before it is unchanged. The scan stays parallel when
    one source was loaded most of the time.
    """
    hashed = loads.select("source_path", seq, content_hash(F.col("text")).alias("content_hash"))
    bucket = id_bucket(F.col(seq))
    before = neighbour(
        hashed, ["source_path"], [seq], bucket, F.col("content_hash"), "_previous"
    )
    changed = ~F.col("content_hash").eqNullSafe(F.col("_previous"))
    flagged = before.withColumn("_changed", changed.cast("bigint"))
    counted = running_total(
        flagged, ["source_path"], [seq], bucket, F.col("_changed"), "version"
    )
    action = (
        F.when(F.col("_previous").isNull(), "created")
        .when(F.col("_changed") == 1, "updated")
        .otherwise("unchanged")
    )
    return counted.withColumn("action", action).select(
        "source_path", seq, "content_hash", "version", "action"
    )


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """Pages of equal canonical URL are versions of one document, in page_id order."""
    loads = pages.select(
        canonical_url(F.col("url")).alias("source_path"), "page_id", F.col("html").alias("text")
    )
    return fold_versions(loads, "page_id")


def terminal_time(status: Column, as_of: Column) -> Column:
    """Extraction time: set only when the status is final."""
    return F.when(status.isin(*fixed.TERMINAL_STATUSES), as_of)


def number_created(planned: DataFrame, top: int | Column) -> DataFrame:
    """Ids for the new documents of a planned load, from ``top`` + 1 on in the order of their paths.

    Only the paths are sorted and numbered; the texts stay where they are.
    """
    paths = planned.filter(F.col("action") == "created").select("source_path")
    ids = dense_ids(paths, ["source_path"], "_new_id", start=top + 1)
    return planned.join(ids, "source_path", "left").withColumn("id", F.coalesce("id", "_new_id")).drop("_new_id")


def apply_documents(
    current: DataFrame, planned: DataFrame, as_of: Column, numbered: bool = False
) -> DataFrame:
    """New document table after a planned load with its extraction results.

    ``planned``: ``plan_ingest`` output with doc_type, attributes,
    extraction_status, extraction_model and ingest_session_id; ``numbered``: it
    has gone through ``number_created`` already. The new texts are joined once,
    with what remains of the rows before; their old texts are not read.
    """
    kept, written = split_documents(current, planned, as_of, numbered)
    return kept.unionByName(written.drop("op"))


def split_documents(
    current: DataFrame, planned: DataFrame, as_of: Column, numbered: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``apply_documents``: rows that stay, and rows of the load with ``op`` (insert or update)."""
    changed = planned.filter(F.col("action") != "unchanged")
    if not numbered:
        changed = number_created(changed, current.agg(F.coalesce(F.max("id"), F.lit(0))).scalar())
    before = current.select(
        "source_path",
        F.struct("id", "source_kind", "created_at", "ingest_session_id").alias("_old"),
    )
    met, old = changed.join(before, "source_path", "left"), F.col("_old")
    created = F.col("action") == "created"

    def stays(name: str, fresh: Column) -> Column:
        return F.when(created, fresh).otherwise(old[name]).alias(name)

    written = met.filter(created | old.isNotNull()).select(
        stays("id", F.col("id")),
        "source_path",
        stays("source_kind", F.col("source_kind")),
        stays("created_at", as_of),
        "title",
        "content_hash",
        F.col("text").alias("raw_content"),
        "doc_type",
        "attributes",
        "extraction_status",
        "extraction_model",
        "version",
        F.coalesce("ingest_session_id", old["ingest_session_id"]).alias("ingest_session_id"),
        terminal_time(F.col("extraction_status"), as_of).alias("extracted_at"),
        F.when(created, "insert").otherwise("update").alias("op"),
    )
    kept = current.join(changed.select("source_path"), "source_path", "left_anti")
    return kept.select(*[c for c in written.columns if c != "op"]), written


def replace_chunks(current: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table without the chunks of changed documents, plus the new ones."""
    return current.join(changed.select("document_id"), "document_id", "left_anti").unionByName(fresh)


# --- entities, mentions, relations, links --------------------------------------------


def upsert_entities(current: DataFrame, named: DataFrame, top: int | None = None) -> DataFrame:
    """Entities after new mentions: known ones take the latest spelling, new ones get ids.

    ``current``: id, entity_type, name, canonical, attributes. ``named``:
    entity_type, name, seq (order of processing). ``top``: the largest id in use,
    where ``current`` is a part of the table only.
    """
    latest = (
        named.withColumn("canonical", canonical_name(F.col("name")))
        .groupBy("entity_type", "canonical")
        .agg(F.max_by("name", "seq").alias("_latest"))
    )
    keys = ["entity_type", "canonical"]
    kept = current.join(latest, keys, "left").select(
        "id", "entity_type", F.coalesce("_latest", "name").alias("name"), "canonical", "attributes"
    )
    start = current.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else top
    new = dense_ids(latest.join(current, keys, "left_anti"), keys, "id", start=start + 1)
    return kept.unionByName(
        new.select("id", "entity_type", F.col("_latest").alias("name"), "canonical", F.lit("{}").alias("attributes"))
    )


def _close_active(hit: Column, as_of: Column) -> Column:
    return F.when(hit & F.col("invalid_at").isNull(), as_of).otherwise(F.col("invalid_at"))


def _close_for(
    current: DataFrame, changed: DataFrame, key: str, as_of: Column
) -> DataFrame:
    """Invalidate the active rows whose ``key`` is among the changed documents."""
    flags = changed.select(F.col("document_id").alias(key), F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False))
    return (
        current.join(flags, key, "left")
        .withColumn("invalid_at", _close_active(hit, as_of))
        .drop("_hit")
        .select(*current.columns)
    )


def _fresh(rows: DataFrame, key: list[str], as_of: Column) -> DataFrame:
    return (
        rows.select(*key)
        .distinct()
        .withColumn("valid_from", as_of)
        .withColumn("invalid_at", F.lit(None).cast("timestamp"))
    )


def replace_mentions(
    current: DataFrame, changed: DataFrame, wanted: DataFrame, as_of: Column
) -> DataFrame:
    """All active mentions of changed documents become history; the wanted set is new rows.

    ``changed``: document_id. ``wanted``: entity_id, document_id, role; a missing
    role counts as one value.
    """
    closed = _close_for(current, changed, "document_id", as_of)
    return closed.unionByName(_fresh(wanted, MENTION, as_of))


def replace_relations(
    current: DataFrame, changed: DataFrame, wanted: DataFrame, as_of: Column
) -> DataFrame:
    """Relations of changed documents: absent ones close, wanted ones are (re)activated in place."""
    keyed = wanted.filter(F.col("source_id") != F.col("target_id")).select(*RELATION).distinct()
    flags = changed.select("document_id", F.lit(True).alias("_hit")).distinct()
    merged = (
        current.join(flags, "document_id", "left")
        .join(keyed.withColumn("_wanted", F.lit(True)), RELATION, "left")
    )
    keep = F.coalesce("_wanted", F.lit(False))
    hit = F.coalesce("_hit", F.lit(False))
    updated = merged.withColumn(
        "invalid_at",
        F.when(keep, F.lit(None).cast("timestamp")).otherwise(_close_active(hit, as_of)),
    ).withColumn("valid_from", F.when(keep, as_of).otherwise(F.col("valid_from")))
    added = _fresh(keyed.join(current, RELATION, "left_anti"), RELATION, as_of)
    return updated.select(*RELATION, "valid_from", "invalid_at").unionByName(added)


def replace_links(
    current: DataFrame,
    pending: DataFrame,
    changed: DataFrame,
    extracted: DataFrame,
    documents: DataFrame,
    as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """New link and pending tables after documents were (re)loaded.

    ``changed``: document_id. ``extracted``: source_id, name of the links found
    in them. ``documents``: the new document table. Outgoing links of changed
    documents close and come back as new rows; their pending names are dropped;
    older pending names are matched against the changed documents.
    """
    closed = _close_for(current, changed, "source_id", as_of)
    resolved, unresolved = resolve_links(extracted, documents)
    reference = F.lit("reference").alias("kind")
    ids = changed.select(F.col("document_id").alias("id"))
    waiting = pending.join(ids, pending["source_id"] == ids["id"], "left_anti")
    created, rest = resolve_pending(waiting, documents.join(ids, "id", "left_semi"))
    wanted = resolved.select("source_id", "target_id", reference).unionByName(created).distinct()
    # a link that is already active is refreshed, not doubled
    refreshed = closed.join(wanted.withColumn("_again", F.lit(True)), LINK, "left")
    live = F.col("_again").isNotNull() & F.col("invalid_at").isNull()
    refreshed = refreshed.withColumn(
        "valid_from", F.when(live, as_of).otherwise(F.col("valid_from"))
    ).select(*LINK, "valid_from", "invalid_at")
    added = _fresh(wanted.join(active(closed), LINK, "left_anti"), LINK, as_of)
    still = rest.unionByName(unresolved.select("source_id", "target_name", reference)).distinct()
    return refreshed.unionByName(added), still


def drop_orphans(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that have a mention or an edge in any state; history protects an entity."""
    used = (
        mentions.select(F.col("entity_id").alias("id"))
        .unionByName(relations.select(F.col("source_id").alias("id")))
        .unionByName(relations.select(F.col("target_id").alias("id")))
        .distinct()
    )
    return entities.join(used, "id", "left_semi")


def orphans(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without any mention or edge, active or not."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return entities.join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti").join(
        ends, "id", "left_anti"
    )


# --- facts --------------------------------------------------------------------------


def close_intervals(versions: DataFrame) -> DataFrame:
    """Recompute invalid_at from the next version of the topic; earlier closings stay.

    ``versions``: id, topic, valid_from, invalid_at and any other columns. Late
    rows find their place in the history.
    """
    following = neighbour(
        versions, ["topic"], ["valid_from", "id"], hour_bucket(F.col("valid_from")),
        F.col("valid_from"), "_next", step=1,
    )
    return following.withColumn("invalid_at", F.least("invalid_at", "_next")).drop("_next")


def upsert_facts(current: DataFrame, new: DataFrame) -> DataFrame:
    """Fact table after new versions: each closes the active version before it.

    ``new`` has the columns of ``current`` without invalid_at.
    """
    added = new.withColumn("invalid_at", F.lit(None).cast("timestamp"))
    touched = new.select("topic").distinct()
    still = current.join(touched, "topic", "left_anti")
    history = current.join(touched, "topic", "left_semi").unionByName(added)
    return still.unionByName(close_intervals(history).select(*current.columns))


def soft_delete(current: DataFrame, topics: DataFrame, as_of: Column) -> DataFrame:
    """Invalidate the active fact of each topic."""
    flags = topics.select("topic", F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False))
    return (
        current.join(flags, "topic", "left")
        .withColumn("invalid_at", _close_active(hit, as_of))
        .select(*current.columns)
    )


def hard_delete(current: DataFrame, topics: DataFrame) -> DataFrame:
    """Remove every version of the topics."""
    return current.join(topics.select("topic"), "topic", "left_anti").select(*current.columns)


def as_of(rows: DataFrame, moment: Column) -> DataFrame:
    """Rows valid at a moment: from valid_from up to, not including, invalid_at."""
    return rows.filter(
        (F.col("valid_from") <= moment)
        & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment))
    )


# --- re-extraction --------------------------------------------------------------------


def reextract(documents: DataFrame, extractions: DataFrame, as_of: Column) -> DataFrame:
    """Rewrite type, attributes and status from new extractions; text and chunks stay.

    ``extractions``: document_id, doc_type, attributes, status, model. Mentions
    and relations follow with ``replace_mentions`` and ``replace_relations``.
    """
    new = extractions.select(
        F.col("document_id").alias("id"),
        F.struct("doc_type", "attributes", "status", "model").alias("_new"),
    )
    merged = documents.join(new, "id", "left")
    hit, fresh = F.col("_new").isNotNull(), F.col("_new")

    def pick(name: str, source: str) -> Column:
        return F.when(hit, fresh[source]).otherwise(F.col(name))

    return (
        merged.withColumn(
            "extracted_at",
            F.when(hit, terminal_time(fresh["status"], as_of)).otherwise(F.col("extracted_at")),
        )
        .withColumn("doc_type", pick("doc_type", "doc_type"))
        .withColumn("attributes", pick("attributes", "attributes"))
        .withColumn("extraction_status", pick("extraction_status", "status"))
        .withColumn("extraction_model", pick("extraction_model", "model"))
        .select(*documents.columns)
    )


def set_type(
    documents: DataFrame, overrides: DataFrame, extractions: DataFrame, as_of: Column
) -> DataFrame:
    """Force document types; an extraction of another type leaves no attributes.

    ``overrides``: document_id, doc_type; only registered types should be asked for.
    """
    forced = overrides.select("document_id", F.col("doc_type").alias("_forced"))
    agreed = extractions.join(forced, "document_id").withColumn(
        "_agrees", F.col("doc_type") == F.col("_forced")
    )
    outcome = agreed.select(
        "document_id",
        F.col("_forced").alias("doc_type"),
        F.when(F.col("_agrees"), F.col("attributes")).otherwise("{}").alias("attributes"),
        F.when(F.col("_agrees"), F.col("status")).otherwise("skipped").alias("status"),
        F.when(F.col("_agrees"), F.col("model")).alias("model"),
    )
    return reextract(documents, outcome, as_of)


# --- checks ---------------------------------------------------------------------------


def duplicate_keys(rows: DataFrame, key: list[str], rule: str) -> DataFrame:
    """One report row: how many keys occur more than once."""
    repeated = rows.groupBy(*key).count().filter(F.col("count") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def broken_rows(rows: DataFrame, broken: Column, rule: str) -> DataFrame:
    """One report row: how many rows break a rule."""
    count = F.count_if(F.coalesce(broken, F.lit(False))).alias("violations")
    return rows.agg(count).select(F.lit(rule).alias("rule"), "violations")


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per rule over the given tables; tables that are not given are skipped."""
    checks = {
        "documents": lambda t: [
            duplicate_keys(t, ["source_path"], "documents: one row per source path"),
            broken_rows(t, ~F.col("extraction_status").isin(*fixed.EXTRACTION_STATUSES), "documents: status"),
            broken_rows(t, ~F.col("source_kind").isin(*fixed.SOURCE_KINDS), "documents: source kind"),
        ],
        "entities": lambda t: [duplicate_keys(t, ["entity_type", "canonical"], "entities: one row per name")],
        "mentions": lambda t: [duplicate_keys(active(t), MENTION, "mentions: one active row per role")],
        "relations": lambda t: [
            duplicate_keys(t, RELATION, "relations: one row per edge"),
            broken_rows(t, F.col("source_id") == F.col("target_id"), "relations: no self edges"),
        ],
        "links": lambda t: [
            duplicate_keys(active(t), LINK, "links: one active row per kind"),
            broken_rows(t, F.col("source_id") == F.col("target_id"), "links: no self links"),
        ],
        "facts": lambda t: [duplicate_keys(active(t), ["topic"], "facts: one active version per topic")],
        "sessions": lambda t: [
            duplicate_keys(t.filter("active"), ["user_id"], "sessions: one active per user")
        ],
        "conversations": lambda t: [
            duplicate_keys(t.filter("active"), ["user_id"], "conversations: one active per user")
        ],
        "messages": lambda t: [
            broken_rows(t, ~F.col("role").isin(*fixed.MESSAGE_ROLES), "messages: role")
        ],
    }
    rows = [row for name, table in tables.items() for row in checks[name](table)]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    return report
