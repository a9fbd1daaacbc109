"""Structured document queries and row filters."""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions import jsonb
from lorehouse.functions.text import canonical_name

DOCUMENT_COLUMNS = ("id", "title", "doc_type", "attributes", "version", "created_at")


def active(rows: DataFrame) -> DataFrame:
    """Rows that have not been invalidated."""
    return rows.filter(F.col("invalid_at").isNull())


def _day(value: Any) -> Column:
    """A filter argument as a date column; NULL when it does not start like one."""
    if isinstance(value, date):
        return F.lit(value).cast("date")
    text = F.lit(value if isinstance(value, str) else None).cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("date"))


def _bound(key: str, column: Column, value: Any) -> Column:
    """The comparison; a NULL bound drops it."""
    day = _day(value)
    return day.isNull() | F.coalesce(column < day if key.endswith("_before") else column > day, F.lit(False))


def _condition(key: str, value: Any) -> Column | None:
    """Predicate of one filter; None when the filter does not apply."""
    if value is None or key == "entity":
        return None
    if key == "doc_type":
        return F.col("doc_type") == F.lit(value)
    if key == "title_contains":
        return F.col("title").ilike(f"%{value}%")
    if key == "attributes":
        if not isinstance(value, dict):
            return None
        return jsonb.contains(F.parse_json("attributes"), value)
    if key in ("created_before", "created_after"):
        return _bound(key, F.to_date("created_at"), value)
    for suffix in ("_before", "_after"):
        if key.endswith(suffix):
            attribute = jsonb.field_date(F.col("attributes"), key[: -len(suffix)])
            return _bound(key, attribute, value)
    return None


def document_predicate(filters: Any) -> Column:
    """AND of the filters a document row can answer by itself."""
    items = filters.items() if isinstance(filters, dict) else ()
    found = [c for c in (_condition(key, value) for key, value in items) if c is not None]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def mentioning(
    documents: DataFrame, mentions: DataFrame, entities: DataFrame, name: str, role: str | None = None
) -> DataFrame:
    """Documents with an active mention of an entity of that name, of any type."""
    who = entities.filter(F.col("canonical") == canonical_name(F.lit(name))).select(
        F.col("id").alias("entity_id")
    )
    hits = active(mentions)
    if role:
        hits = hits.filter(F.col("role") == role)
    hits = hits.join(who, "entity_id", "left_semi").select(F.col("document_id").alias("id"))
    return documents.join(hits, "id", "left_semi")


def filter_documents(
    documents: DataFrame,
    filters: Any = None,
    *,
    mentions: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Documents that satisfy every filter; unusable filters are skipped."""
    kept = documents.filter(document_predicate(filters))
    entity = filters.get("entity") if isinstance(filters, dict) else None
    if isinstance(entity, dict) and entity.get("name"):
        if mentions is None or entities is None:
            raise ValueError("an entity filter needs mentions and entities")
        role = entity.get("role")
        kept = mentioning(kept, mentions, entities, str(entity["name"]), str(role) if role else None)
    return kept


def query_documents(
    documents: DataFrame, filters: Any = None, *, limit: int = fixed.DOCUMENT_LIMIT, **tables: DataFrame
) -> DataFrame:
    """Newest matching documents without their text."""
    kept = filter_documents(documents, filters, **tables)
    return (
        kept.select(*DOCUMENT_COLUMNS).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    )


def count_documents(documents: DataFrame, filters: Any = None, **tables: DataFrame) -> DataFrame:
    """Number of matching documents."""
    return filter_documents(documents, filters, **tables).agg(F.count(F.lit(1)).alias("total"))


def query_page(
    documents: DataFrame, filters: Any = None, *, limit: int = fixed.DOCUMENT_LIMIT, **tables: DataFrame
) -> DataFrame:
    """A page with the total number of matches, reported only when the page is not enough."""
    page = query_documents(documents, filters, limit=limit, **tables)
    total = count_documents(documents, filters, **tables).scalar()
    return page.withColumn("total", F.when(total > limit, total))


def reextract_candidates(
    documents: DataFrame,
    *,
    status: str | None = None,
    doc_type: str | None = None,
    not_model: str | None = None,
) -> DataFrame:
    """Ids of documents to extract again; a NULL model differs from every model."""
    kept = documents
    if status is not None:
        kept = kept.filter(F.col("extraction_status") == status)
    if doc_type is not None:
        kept = kept.filter(F.col("doc_type") == doc_type)
    if not_model is not None:
        kept = kept.filter(~F.col("extraction_model").eqNullSafe(F.lit(not_model)))
    return kept.select("id").orderBy("id")


def refresh_candidates(documents: DataFrame) -> DataFrame:
    """Source paths of web documents in id order."""
    return documents.filter(F.col("source_kind") == "url").select("id", "source_path").orderBy("id")


def whitelist(rows: DataFrame, users: DataFrame, key: str = "telegram_id") -> DataFrame:
    """Rows of known users."""
    return rows.join(users.select(key), key, "left_semi")


def strangers(rows: DataFrame, users: DataFrame, key: str = "telegram_id") -> DataFrame:
    """Rows of unknown users."""
    return rows.join(users.select(key), key, "left_anti")


def idle(sessions: DataFrame, as_of: Column, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """Active sessions whose last activity is more than ``minutes`` before ``as_of``."""
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return sessions.filter(F.col("active") & (F.col("last_active_at") < limit))
