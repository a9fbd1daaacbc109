"""Corpus, graph, cost, session, history and evaluation reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.functions.text import parse_verdict
from lorehouse.operators import evaluation as E
from lorehouse.operators import history as H
from lorehouse.operators import reports as R
from lorehouse.operators.hybrid import rank_in_list as number_lists
from lorehouse.operators.hybrid import search_chunks
from lorehouse.plans.catalog import query
from lorehouse.plans.prelude import AS_OF, PRELUDE
from lorehouse.plans.search_queries import DIM, embedded_chunks
from lorehouse.plans.views import AS_OF as MOMENT
from lorehouse.plans.views import Tables
from lorehouse.session import cut_lineage


def _moment():
    return F.lit(MOMENT).cast("timestamp")


@query(
    PRELUDE + """SELECT 'documents by type' AS section, doc_type AS label, count(*) AS n FROM base_documents GROUP BY 2
  UNION ALL SELECT 'documents by status', extraction_status, count(*) FROM base_documents GROUP BY 2
  UNION ALL SELECT 'entities by type', entity_type, count(*) FROM base_entities GROUP BY 2
  UNION ALL SELECT 'chunks', NULL, count(*) FROM base_chunks
  UNION ALL SELECT 'active facts', NULL, count(*) FROM base_facts WHERE invalid_at IS NULL"""
)
def corpus_stats(t: Tables) -> DataFrame:
    return R.corpus_stats(t.documents(), t.entities(), t.chunks(), t.facts())


@query(
    PRELUDE + """SELECT 'nodes by type' AS section, entity_type AS label, count(*) AS n FROM base_entities GROUP BY 2
  UNION ALL SELECT 'edges by relation', relation, count(*) FROM base_relations WHERE invalid_at IS NULL GROUP BY 2"""
)
def graph_stats(t: Tables) -> DataFrame:
    return R.graph_stats(t.entities(), t.relations())


_ENDS = """(SELECT source_id AS id FROM base_relations WHERE invalid_at IS NULL
  UNION ALL SELECT target_id FROM base_relations WHERE invalid_at IS NULL)"""


@query(
    PRELUDE + f"""SELECT id, count(*) AS degree, any_value(name) AS name, any_value(entity_type) AS entity_type
  FROM {_ENDS} JOIN base_entities USING (id) GROUP BY id ORDER BY degree DESC, id LIMIT 10"""
)
def degree_top_k(t: Tables) -> DataFrame:
    return R.degree_top_k(t.entities(), t.relations())


@query(PRELUDE + f"SELECT count(*) AS isolated FROM base_entities WHERE id NOT IN {_ENDS}")
def isolated_count(t: Tables) -> DataFrame:
    return R.isolated_count(t.entities(), t.relations())


@query(
    PRELUDE + f"""SELECT round(sum(value), 4) AS cost, sum(value) >= 20.0 AS limited FROM base_messages
  WHERE event_type NOT IN ('view', 'error') AND created_at >= date_trunc('month', {AS_OF})"""
)
def month_budget(t: Tables) -> DataFrame:
    return R.budget_state(t.messages(), _moment()).withColumn("cost", F.round("cost", 4))


@query(
    PRELUDE + """SELECT CASE WHEN event_type <> 'signup' THEN event_type END AS model,
  round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS cost, count(*) AS calls
  FROM base_messages WHERE event_type <> 'view' GROUP BY 1"""
)
def cost_by_model(t: Tables) -> DataFrame:
    return R.cost_by_model(t.messages()).withColumn("cost", F.round("cost", 4))


@query(
    PRELUDE + """SELECT u.name, round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS cost
  FROM base_messages m JOIN base_users u ON u.id = m.conversation_id WHERE event_type <> 'view' GROUP BY 1"""
)
def cost_by_user(t: Tables) -> DataFrame:
    return R.cost_by_user(t.messages(), t.owners(), t.users()).withColumn("cost", F.round("cost", 4))


@query(
    PRELUDE + """SELECT conversation_id, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(id % 100) AS BIGINT) AS completion_tokens,
  CAST(sum(k + id % 100) AS BIGINT) AS total_tokens, CAST(sum(k % 10) AS BIGINT) AS cached_tokens,
  CAST(sum(CASE WHEN k % 3 <> 0 THEN k % 3 ELSE k % 5 END) AS BIGINT) AS cache_write_tokens,
  round(sum(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE value END), 4) AS cost
  FROM base_messages GROUP BY 1"""
)
def usage_totals(t: Tables) -> DataFrame:
    return R.usage_totals(t.messages()).withColumn("cost", F.round("cost", 4))


@query(PRELUDE + "SELECT document_id, count(*) AS chunks FROM base_chunks GROUP BY 1")
def chunk_counts(t: Tables) -> DataFrame:
    return R.chunk_counts(t.chunks())


@query(
    PRELUDE + """SELECT s.id AS session_id, u.name, s.started_at, s.last_active_at,
    (SELECT count(*) FROM base_buffered b WHERE b.session_id = s.id) AS buffered,
    (SELECT count(*) FROM base_documents d WHERE d.ingest_session_id = s.id) AS docs
  FROM base_sessions s JOIN base_users u ON u.id = s.user_id WHERE s.active"""
)
def session_report(t: Tables) -> DataFrame:
    return R.session_report(t.sessions(), t.users(), t.buffered(), t.documents())


@query(PRELUDE + "SELECT topic, valid_from AS updated_at, length(content) AS length FROM base_facts WHERE invalid_at IS NULL")
def fact_topics(t: Tables) -> DataFrame:
    return R.fact_topics(t.facts())


@query(PRELUDE + "SELECT topic, content, valid_from FROM base_facts WHERE invalid_at IS NULL")
def active_facts(t: Tables) -> DataFrame:
    return R.list_facts(t.facts())


@query(
    PRELUDE + """SELECT left(block, 1000) AS block, length(block) > 1000 AS truncated FROM (
    SELECT 'АКТУАЛЬНЫЕ ФАКТЫ:' || chr(10) || string_agg('[' || topic || ']: ' || content, chr(10) ORDER BY topic) AS block
    FROM base_facts WHERE invalid_at IS NULL)"""
)
def facts_block(t: Tables) -> DataFrame:
    return R.facts_block(t.facts(), 1000)


@query(PRELUDE + "SELECT session_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS content FROM base_buffered GROUP BY 1")
def session_contents(t: Tables) -> DataFrame:
    return R.close_buffer(t.buffered())


@query(
    PRELUDE + """SELECT session_id, max(ts) AS last_active_at FROM (SELECT session_id, ts FROM base_buffered
  UNION ALL SELECT ingest_session_id, created_at FROM base_documents WHERE ingest_session_id IS NOT NULL) GROUP BY 1"""
)
def last_activity(t: Tables) -> DataFrame:
    attached = t.documents().filter(F.col("ingest_session_id").isNotNull()).select(
        F.col("ingest_session_id").alias("session_id"), F.col("created_at").alias("ts")
    )
    return R.last_activity(t.buffered(), attached)


@query(
    PRELUDE + """SELECT f.id AS fact_id, f.topic, x.kind, x.number, x.text FROM base_facts f LEFT JOIN (
    SELECT session_id, 'message' AS kind, seq AS number, text FROM base_buffered
    UNION ALL SELECT ingest_session_id, 'document', id, title FROM base_documents WHERE ingest_session_id IS NOT NULL) x
  ON x.session_id = f.session_id"""
)
def trace_facts(t: Tables) -> DataFrame:
    return R.trace_facts(t.facts(), t.buffered(), t.documents()).select("fact_id", "topic", "kind", "number", "text")


@query(
    PRELUDE + """SELECT d.id AS document_id, d.ingest_session_id AS session_id, f.id AS fact_id, f.topic
  FROM base_documents d LEFT JOIN base_facts f ON f.session_id = d.ingest_session_id"""
)
def trace_documents(t: Tables) -> DataFrame:
    return R.trace_documents(t.documents(), t.facts()).select("document_id", "session_id", "fact_id", "topic")


# --- histories -------------------------------------------------------------------------


@query(
    PRELUDE + """SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS place FROM (
  SELECT id, conversation_id FROM base_messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 8)"""
)
def last_messages(t: Tables) -> DataFrame:
    return H.last_messages(t.messages()).select("id", "conversation_id", "place")


@query(
    """SELECT event_id AS id, user_id AS session_id,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) + coalesce((SELECT max(turn) FROM conversations c WHERE c.conv_id = user_id), 0) AS seq
  FROM events"""
)
def assign_seq(t: Tables) -> DataFrame:
    arrivals = t.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"))
    held = t.raw("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"))
    return H.assign_seq(arrivals, held)


@query(
    """WITH c AS (SELECT DISTINCT conv_id AS id, conv_id % 20 AS user_id, conv_id % 3 <> 0 AS active FROM conversations)
  SELECT id, user_id, active AND id = (SELECT max(id) FROM c d WHERE d.user_id = c.user_id AND d.active) AS active FROM c"""
)
def keep_newest_active(t: Tables) -> DataFrame:
    n = F.col("conv_id")
    rows = t.raw("conversations").select(n.alias("id"), (n % 20).alias("user_id"), (n % 3 != 0).alias("active"))
    return H.keep_newest_active(rows.distinct())


@query(
    PRELUDE + """SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY valid_from, id) AS number, valid_from,
  invalid_at AS until FROM base_facts"""
)
def fact_history(t: Tables) -> DataFrame:
    return H.fact_history(t.facts().withColumn("invalid_at", F.lit(None).cast("timestamp"))).select(
        "id", "topic", "number", "valid_from", "until"
    )


@query(
    """SELECT user_id AS query_id, event_type AS list, event_id AS item_id,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events"""
)
def rank_in_list(t: Tables) -> DataFrame:
    scored = t.raw("events").select(
        F.col("user_id").alias("query_id"), F.col("event_type").alias("list"), F.col("event_id").alias("item_id"), "value"
    )
    return number_lists(scored, "value").drop("value")


# --- evaluation --------------------------------------------------------------------------

_LABELS = """labels_base AS (SELECT doc_id, ['generic','regulation','instruction','faq','meeting_notes'][(doc_id + CASE WHEN toxic = 1 THEN 1 ELSE 0 END) % 5 + 1] AS label_type,
  quality FROM labels)"""


@query(
    PRELUDE + f""", {_LABELS} SELECT 'DOC ' || doc_id AS title, label_type, doc_id AS document_id, doc_type
  FROM labels_base JOIN base_documents ON id = doc_id"""
)
def label_lookup(t: Tables) -> DataFrame:
    return E.label_lookup(t.labels(), t.documents()).select("title", "label_type", "document_id", "doc_type")


@query(
    PRELUDE + f""", {_LABELS} SELECT round(avg(CASE WHEN label_type = doc_type THEN 1.0 ELSE 0.0 END), 6) AS type_accuracy
  FROM labels_base JOIN base_documents ON id = doc_id"""
)
def type_accuracy(t: Tables) -> DataFrame:
    return E.type_accuracy(t.labels(), t.documents()).withColumn("type_accuracy", F.round("type_accuracy", 6))


#: Whether each required attribute stands in the document's own JSON.
_PRESENT = """present AS (SELECT coalesce(json_extract_string(attributes, '$.' || field), '') NOT IN ('', '[]') AS has
  FROM labels l JOIN base_documents d ON d.id = l.doc_id, (VALUES ('owner'), ('status'), ('approver')) f(field)
  WHERE field = 'owner' OR field = CASE WHEN l.quality = 1 THEN 'status' ELSE 'approver' END)"""


@query(PRELUDE + f", {_PRESENT} SELECT round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6) AS attribute_completeness FROM present")
def attribute_completeness(t: Tables) -> DataFrame:
    out = E.attribute_completeness(t.labels(), t.documents())
    return out.withColumn("attribute_completeness", F.round("attribute_completeness", 6))


def _search_results(t: Tables, chunks: DataFrame | None = None) -> DataFrame:
    chunks = embedded_chunks(t) if chunks is None else chunks
    found = search_chunks(t.questions(), chunks, t.documents(), dim=DIM)
    return found.withColumnRenamed("query_id", "question_id")


_HOLDERS = """holders AS (SELECT item_id, id FROM benchmark b JOIN base_documents d ON contains(d.raw_content, b.text))"""


@query(
    PRELUDE + f""", {_HOLDERS} SELECT round(avg(hit), 6) AS recall_at_4 FROM (
    SELECT item_id, max(CASE WHEN EXISTS (SELECT 1 FROM base_found f JOIN holders h ON h.item_id = b.item_id AND h.id = f.chunk_id // 1000000
      WHERE f.query_id = b.item_id) THEN 1.0 ELSE 0.0 END) AS hit FROM holders b GROUP BY 1)"""
)
def recall_at_4(t: Tables) -> DataFrame:
    """Passages that occur word for word in documents are the questions with known answers."""
    chunks = embedded_chunks(t)
    passages = t.questions().withColumnRenamed("query", "text")
    holders = E.passage_holders(passages, t.documents(), chunks).join(t.documents().select("id", "title"), "id")
    # written, as the questions and both forms of an expected document are read from it
    expected = cut_lineage(holders.select(F.col("query_id").alias("question_id"), F.col("title").alias("want")), "expected")
    questions = expected.select("question_id").distinct()
    return E.recall_at_k(questions, _search_results(t, chunks), expected).withColumn("recall_at_4", F.round("recall_at_4", 6))


@query(
    "SELECT round(avg(CASE WHEN (conv_id + turn) % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS refusals FROM conversations WHERE role = 'assistant' AND conv_id % 6 = 0"
)
def refusal_rate(t: Tables) -> DataFrame:
    outside = t.answers().filter("out_of_corpus")
    return E.refusal_rate(outside).withColumn("refusals", F.round("refusals", 6))


_REPORT = """r AS (SELECT conv_id % 6 = 0 AS outside, CASE (conv_id + turn) % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'clarification' ELSE 'answered' END AS category,
  ['correct','partial','incorrect','unknown','false_refusal','correct_refusal'][(conv_id + turn * 3) % 6 + 1] AS verdict
  FROM conversations WHERE role = 'assistant')"""


@query(
    f"""WITH {_REPORT}, lines AS (
    SELECT 'in-corpus deflection' AS metric, NULL AS label, count(*) FILTER (WHERE category <> 'answered') AS n, count(*) AS of FROM r WHERE NOT outside
    UNION ALL SELECT 'out-of-corpus refusals', NULL, count(*) FILTER (WHERE category = 'refused'), count(*) FROM r WHERE outside
    UNION ALL SELECT 'in-corpus correct', NULL, count(*) FILTER (WHERE verdict = 'correct'),
      count(*) FILTER (WHERE verdict IN ('correct', 'partial', 'incorrect')) FROM r WHERE NOT outside
    UNION ALL SELECT 'category', category, count(*), NULL FROM r GROUP BY 2
    UNION ALL SELECT 'verdict', verdict, count(*), NULL FROM r GROUP BY 2)
  SELECT *, CASE WHEN of > 0 THEN n * 100 // of END AS percent FROM lines"""
)
def eval_report(t: Tables) -> DataFrame:
    results = t.answers().withColumn("verdict", parse_verdict(F.col("verdict_text")))
    return E.eval_report(results)


@query(
    PRELUDE + f""", {_LABELS}, {_PRESENT}, values_base AS (
    SELECT 'type_accuracy' AS metric, (SELECT avg(CASE WHEN label_type = doc_type THEN 1.0 ELSE 0.0 END) FROM labels_base JOIN base_documents ON id = doc_id) AS value
    UNION ALL SELECT 'attribute_completeness', (SELECT avg(CASE WHEN has THEN 1.0 ELSE 0.0 END) FROM present)
    UNION ALL SELECT 'refusals', (SELECT avg(CASE WHEN (conv_id + turn) % 5 = 0 THEN 1.0 ELSE 0.0 END) FROM conversations WHERE role = 'assistant' AND conv_id % 6 = 0)
    UNION ALL SELECT 'recall_at_4', NULL UNION ALL SELECT 'graph_accuracy', NULL)
  SELECT metric, CAST({{}} AS DOUBLE) AS threshold, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'n/a' WHEN value >= {{}} THEN 'ok' ELSE 'FAIL' END AS verdict FROM values_base""".replace(
        "{}",
        "CASE metric WHEN 'type_accuracy' THEN 0.9 WHEN 'recall_at_4' THEN 0.85 WHEN 'attribute_completeness' THEN 0.8 WHEN 'graph_accuracy' THEN 0.75 ELSE 1.0 END",
    )
)
def threshold_gate(t: Tables) -> DataFrame:
    def named(metric: DataFrame) -> DataFrame:
        (name,) = metric.columns
        return metric.select(F.lit(name).alias("metric"), F.col(name).alias("value"))

    metrics = (
        named(E.type_accuracy(t.labels(), t.documents()))
        .unionByName(named(E.attribute_completeness(t.labels(), t.documents())))
        .unionByName(named(E.refusal_rate(t.answers().filter("out_of_corpus"))))
    )
    return E.threshold_gate(metrics).withColumn("value", F.round("value", 6))
