"""Sessions, routing and ingest: batch twins and the streaming jobs run to completion."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.functions.text import content_hash
from lorehouse.operators import sessions as S
from lorehouse.operators.history import conversation_segments as number_segments
from lorehouse.plans.catalog import query
from lorehouse.plans.prelude import PRELUDE
from lorehouse.plans.views import Tables
from lorehouse.session import fresh_path
from lorehouse.streaming import ingest as I
from lorehouse.streaming import sessions as R

DAY = 1440

_ISLANDS = """isl AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, id) AS segment FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS brk
  FROM base_session_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)))"""


@query(
    PRELUDE + f""", {_ISLANDS} SELECT user_id, CAST(segment AS BIGINT) AS segment, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events
  FROM isl GROUP BY 1, 2"""
)
def idle_sessions(t: Tables) -> DataFrame:
    return S.idle_sessions(t.session_events())


@query(
    PRELUDE + f""", {_ISLANDS} SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events,
    string_agg(text, chr(10) || chr(10) ORDER BY ts, id) AS content
  FROM isl GROUP BY user_id, segment HAVING max(ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)"""
)
def idle_sessions_stream(t: Tables) -> DataFrame:
    stream = R.idle_sessions(t.session_events(t.stream("events")))
    path = fresh_path(t.spark, "idle")
    R.run_available(stream, path)
    return R.read_results(stream, path)


_TOGGLED = """toggled AS (SELECT user_id, segment, CAST(ceil(toggles / 2.0) AS BIGINT) AS session, min(ts) AS opened_at, max(ts) AS last_active_at,
  count(*) FILTER (WHERE kind = 'text') AS texts, count(*) FILTER (WHERE kind = 'document') AS documents,
  max(CASE WHEN kind = 'toggle' AND toggles % 2 = 0 THEN ts END) AS toggled, arg_max(coalesce(next_at, TIMESTAMP '9999-01-01'), ts) AS contact
  FROM base_states WHERE kind = 'toggle' OR toggles % 2 = 1 GROUP BY 1, 2, 3)"""

_SESSIONS = """SELECT user_id, {0} opened_at, last_active_at, texts, documents,
  CASE WHEN toggled IS NOT NULL THEN 'toggle' WHEN contact < TIMESTAMP '9999-01-01' THEN 'idle' ELSE 'open' END AS ending,
  CASE WHEN toggled IS NOT NULL THEN toggled WHEN contact < TIMESTAMP '9999-01-01' THEN contact END AS closed_at,
  CASE WHEN toggled IS NULL AND contact = TIMESTAMP '9999-01-01' THEN NULL WHEN texts > 0 THEN 'saved' WHEN documents > 0 THEN 'documents' ELSE 'empty' END AS outcome
  FROM toggled"""


@query(PRELUDE + f", {_TOGGLED} " + _SESSIONS.format("CAST(segment AS BIGINT) AS segment, session,"))
def toggle_sessions(t: Tables) -> DataFrame:
    return S.toggle_sessions(t.session_events(), DAY)


@query(
    PRELUDE + f""", {_TOGGLED} SELECT user_id, opened_at, last_active_at, texts, documents, toggled AS closed_at,
  CASE WHEN toggled IS NOT NULL THEN 'toggle' ELSE 'idle' END AS ending,
  CASE WHEN texts > 0 THEN 'saved' WHEN documents > 0 THEN 'documents' ELSE 'empty' END AS outcome
  FROM toggled WHERE toggled IS NOT NULL OR contact < TIMESTAMP '9999-01-01'
    OR epoch_ms(last_active_at) + 86400001 < epoch_ms((SELECT max(ts) FROM events)) - 600000"""
)
def toggle_sessions_stream(t: Tables) -> DataFrame:
    """Closed sessions. When an idle one was noticed depends on the micro-batches, so only toggles give a closing time."""
    stream = R.toggle_sessions(t.session_events(t.stream("events")), DAY)
    path = fresh_path(t.spark, "toggle")
    R.run_available(stream, path)
    return R.read_results(stream, path).withColumn("closed_at", F.when(F.col("ending") == "toggle", F.col("closed_at")))


@query(
    PRELUDE + """SELECT user_id, CAST(segment AS BIGINT) AS segment, CAST(ceil(toggles / 2.0) AS BIGINT) AS session, id,
  row_number() OVER (PARTITION BY user_id, segment, ceil(toggles / 2.0) ORDER BY ts, id) AS seq
  FROM base_states WHERE kind = 'text' AND toggles % 2 = 1"""
)
def session_texts(t: Tables) -> DataFrame:
    return S.session_texts(t.session_events(), DAY).select("user_id", "segment", "session", "id", "seq")


@query(
    PRELUDE + """SELECT id, CASE WHEN kind = 'document' THEN 'page' WHEN kind = 'text' AND toggles % 2 = 1 THEN 'buffer' ELSE 'question' END AS route
  FROM base_states WHERE kind <> 'toggle'"""
)
def route_messages(t: Tables) -> DataFrame:
    kind = F.col("kind")
    text = F.when(kind == "document", F.concat(F.lit("http://x.y/"), "id", F.lit(" https://z.w"))).otherwise(F.col("text"))
    events = t.session_events().select("user_id", "ts", "id", (kind == "toggle").alias("is_toggle"), text.alias("text"))
    return S.route_messages(events, DAY).select("id", "route")


_SEGMENTS = """SELECT user_id, id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY resets) AS BIGINT) AS segment FROM (
  SELECT user_id, event_id AS id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS resets
  FROM events) WHERE event_type <> 'error'"""


@query(_SEGMENTS)
def conversation_segments(t: Tables) -> DataFrame:
    events = t.raw("events").select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    return number_segments(events, F.col("event_type") == "error").select("user_id", "id", "segment")


@query(_SEGMENTS)
def conversation_segments_stream(t: Tables) -> DataFrame:
    events = t.stream("events").select(
        "user_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("is_reset")
    )
    stream = R.conversation_segments(events)
    path = fresh_path(t.spark, "segments")
    R.run_available(stream, path)
    return R.read_results(stream, path)


@query(
    """SELECT user_id AS conversation_id, event_id AS id, event_type AS role, props AS text FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 8"""
)
def rolling_context_stream(t: Tables) -> DataFrame:
    messages = t.stream("events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("id"),
        F.col("event_type").alias("role"), F.col("props").alias("text"),
    )
    stream = R.rolling_context(messages)
    path = fresh_path(t.spark, "context")
    R.run_available(stream, path, "update")
    return R.read_results(stream, path, latest=["conversation_id"])


@query(
    PRELUDE + """SELECT date_trunc('month', created_at)::TIMESTAMP AS month, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 4) AS cost,
  sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) >= 20.0 AS limited FROM base_messages WHERE event_type <> 'view' GROUP BY 1"""
)
def month_spend_stream(t: Tables) -> DataFrame:
    events = t.stream("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    stream = R.running_month_spend(t.as_messages(events))
    path = fresh_path(t.spark, "spend")
    R.run_available(stream, path, "update")
    return R.read_results(stream, path, latest=["month"]).withColumn("cost", F.round("cost", 4))


@query(
    """SELECT source_path, sha256(text) AS content_hash, 1 AS version, 'pending' AS extraction_status
  FROM (SELECT text, source || '/' || doc_id AS source_path FROM documents)"""
)
def ingest_stream(t: Tables) -> DataFrame:
    """Documents arriving as a stream; ids depend on the order of arrival and are left out."""
    arrivals = t.stream("documents").select(
        F.concat_ws("/", "source", "doc_id").alias("source_path"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        "text", F.lit("file").alias("source_kind"), F.col("doc_id").alias("seq"),
    )
    path = fresh_path(t.spark, "ingest")
    I.ingest_documents(arrivals, path, datetime(2024, 1, 20, 12))
    after = I.last_state(t.spark, path, "documents", I.DOCUMENTS)
    return after.select("source_path", content_hash(F.col("raw_content")).alias("content_hash"), "version", "extraction_status")


@query(
    """SELECT event_id AS id, event_type || '-' || (user_id % 10) AS topic, ts AS valid_from,
  lead(ts) OVER (PARTITION BY event_type || '-' || (user_id % 10) ORDER BY ts, event_id) AS invalid_at FROM events"""
)
def fact_stream(t: Tables) -> DataFrame:
    arrivals = t.stream("events").select(
        F.col("event_id").alias("id"), F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("topic"),
        F.col("props").alias("content"), F.col("ts").alias("valid_from"),
    )
    path = fresh_path(t.spark, "facts")
    I.ingest_facts(arrivals, path)
    return I.last_state(t.spark, path, "facts", I.FACTS).select("id", "topic", "valid_from", "invalid_at")
