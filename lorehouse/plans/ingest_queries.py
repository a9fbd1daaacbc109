"""Extraction results, versioned documents and bitemporal tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.functions.jsonb import field_text
from lorehouse.operators import extraction as X
from lorehouse.operators import versions as V
from lorehouse.operators.chunking import chunk_documents
from lorehouse.operators.links import resolve_relations as relation_ids
from lorehouse.plans.catalog import query
from lorehouse.plans.prelude import AS_OF, PRELUDE
from lorehouse.plans.views import AS_OF as MOMENT
from lorehouse.plans.views import Tables


def _moment():
    return F.lit(MOMENT).cast("timestamp")


# --- extraction --------------------------------------------------------------------------


@query(
    PRELUDE + """SELECT document_id, doc_type, confidence, status,
  CASE WHEN with_attributes AND doc_type = 'regulation' THEN source END AS owner,
  CASE WHEN with_attributes AND doc_type IN ('instruction', 'faq') THEN source END AS topic,
  CASE WHEN with_attributes AND doc_type = 'meeting_notes' THEN '2024-02-0' || (document_id % 9 + 1) END AS meeting_date,
  CASE WHEN with_attributes AND doc_type = 'instruction' THEN '["a","' || lang || '"]' END AS systems,
  CASE WHEN with_attributes AND doc_type = 'generic' THEN lang END AS language,
  CAST(NULL AS VARCHAR) AS extra FROM base_extractions"""
)
def normalize_extractions(t: Tables) -> DataFrame:
    out = X.normalize_extractions(t.raw_extractions())
    fields = ("owner", "topic", "meeting_date", "systems", "language", "extra")
    return out.select(
        "document_id", "doc_type", "confidence", "status", *[field_text(F.col("attributes"), f).alias(f) for f in fields]
    )


_NAMED = """, named AS (
  SELECT document_id, 0 AS pos, 'person' AS entity_type, ' Ann ' || (document_id % 50) || ' ' AS name, 'owner' AS role FROM base_extractions WHERE with_envelope
  UNION ALL SELECT document_id, 1, 'product', source, NULL FROM base_extractions WHERE with_envelope
  UNION ALL SELECT document_id, 2, 'process', lang, NULL FROM base_extractions WHERE with_envelope)"""


@query(PRELUDE + _NAMED + "SELECT * FROM named")
def extracted_entities(t: Tables) -> DataFrame:
    return X.extracted_entities(X.normalize_extractions(t.raw_extractions()))


@query(
    PRELUDE + """SELECT document_id, 0 AS pos, 'ANN ' || (document_id % 50) AS source, source AS target, 'owns' AS relation FROM base_extractions WHERE with_envelope
  UNION ALL SELECT document_id, 1, source, 'missing', 'owns' FROM base_extractions WHERE with_envelope"""
)
def extracted_relations(t: Tables) -> DataFrame:
    return X.extracted_relations(X.normalize_extractions(t.raw_extractions()))


@query(
    PRELUDE + """SELECT document_id AS source_id, 'doc ' || (document_id // 2) AS name FROM base_extractions WHERE with_envelope
  UNION ALL SELECT document_id, 'doc ' || (document_id + 1) FROM base_extractions WHERE with_envelope"""
)
def extracted_links(t: Tables) -> DataFrame:
    return X.extracted_links(X.normalize_extractions(t.raw_extractions()))


def _known_entities(t: Tables) -> DataFrame:
    """Entities of an earlier load: the languages and one name per source."""
    d = t.raw("documents")
    old = d.select(F.lit("process").alias("entity_type"), F.upper("lang").alias("name")).distinct()
    return old.select(
        F.ascii("name").cast("bigint").alias("id"), "entity_type", "name", F.lower("name").alias("canonical"),
        F.lit("{}").alias("attributes"),
    )


_UPSERTED = _NAMED + """, latest AS (
  SELECT entity_type, lower(trim(name)) AS canonical, arg_max(name, document_id * 10 + pos) AS name FROM named GROUP BY 1, 2
), old AS (SELECT DISTINCT CAST(ascii(upper(lang)) AS BIGINT) AS id, upper(lang) AS name, lang AS canonical FROM documents
), upserted AS (
  SELECT o.id, 'process' AS entity_type, coalesce(l.name, o.name) AS name, o.canonical FROM old o LEFT JOIN latest l ON l.entity_type = 'process' AND l.canonical = o.canonical
  UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY entity_type, canonical), entity_type, name, canonical
  FROM latest WHERE NOT (entity_type = 'process' AND canonical IN (SELECT canonical FROM old)))"""


def _upserted(t: Tables) -> DataFrame:
    named = X.extracted_entities(X.normalize_extractions(t.raw_extractions()))
    return V.upsert_entities(_known_entities(t), named.withColumn("seq", F.col("document_id") * 10 + F.col("pos")))


@query(PRELUDE + _UPSERTED + "SELECT id, entity_type, name, canonical FROM upserted")
def upsert_entities(t: Tables) -> DataFrame:
    return _upserted(t).drop("attributes")


@query(
    PRELUDE + _UPSERTED + """SELECT e.document_id, a.id AS source_id, b.id AS target_id, 'owns' AS relation FROM base_extractions e
  JOIN upserted a ON a.entity_type = 'person' AND a.canonical = 'ann ' || (e.document_id % 50)
  JOIN upserted b ON b.entity_type = 'product' AND b.canonical = lower(e.source) WHERE e.with_envelope"""
)
def resolve_relations(t: Tables) -> DataFrame:
    extractions = X.normalize_extractions(t.raw_extractions())
    return relation_ids(
        X.extracted_relations(extractions), X.extracted_entities(extractions), _upserted(t)
    )


# --- documents ------------------------------------------------------------------------------

_PLAN = """, plan AS (SELECT s.source_path, s.text, sha256(s.text) AS content_hash, CAST(f.source_path AS BIGINT) AS id,
  CASE WHEN f.source_path IS NULL THEN 'created' WHEN sha256(f.text) = sha256(s.text) THEN 'unchanged' ELSE 'updated' END AS action
  FROM base_second_load s LEFT JOIN base_first_load f USING (source_path))"""


@query(
    PRELUDE + _PLAN + "SELECT source_path, id, content_hash, action, CASE action WHEN 'updated' THEN 2 ELSE 1 END AS version FROM plan"
)
def plan_ingest(t: Tables) -> DataFrame:
    return V.plan_ingest(t.incoming_documents(), t.current_documents()).select(
        "source_path", "id", "content_hash", "action", "version"
    )


@query(
    PRELUDE + """, chain AS (SELECT *, lag(hash) OVER (PARTITION BY source_path ORDER BY seq) AS before FROM (
    SELECT source_path, seq, sha256(text) AS hash FROM base_first_load UNION ALL SELECT source_path, seq, sha256(text) FROM base_second_load))
  SELECT source_path, seq, hash AS content_hash, CAST(sum(CASE WHEN hash IS DISTINCT FROM before THEN 1 ELSE 0 END)
    OVER (PARTITION BY source_path ORDER BY seq) AS BIGINT) AS version,
    CASE WHEN before IS NULL THEN 'created' WHEN hash = before THEN 'unchanged' ELSE 'updated' END AS action FROM chain"""
)
def fold_versions(t: Tables) -> DataFrame:
    return V.fold_versions(t.loads())


@query(
    r"""WITH p AS (SELECT page_id, sha256(html) AS hash, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
    'utm_[^&]*&?', '', 'g'), '[/?&]+$', '') AS source_path FROM pages)
  SELECT source_path, page_id, hash AS content_hash, CAST(sum(CASE WHEN hash IS DISTINCT FROM before THEN 1 ELSE 0 END)
    OVER (PARTITION BY source_path ORDER BY page_id) AS BIGINT) AS version,
    CASE WHEN before IS NULL THEN 'created' WHEN hash = before THEN 'unchanged' ELSE 'updated' END AS action
  FROM (SELECT *, lag(hash) OVER (PARTITION BY source_path ORDER BY page_id) AS before FROM p)"""
)
def dedupe_pages(t: Tables) -> DataFrame:
    return V.dedupe_pages(t.raw("pages"))


def _planned(t: Tables) -> DataFrame:
    return V.plan_ingest(t.incoming_documents(), t.current_documents()).select(
        "*",
        F.lit("faq").alias("doc_type"),
        F.lit('{"topic":"x"}').alias("attributes"),
        F.when(F.length("text") % 2 == 0, "done").otherwise("pending").alias("extraction_status"),
        F.lit("m").alias("extraction_model"),
        F.lit(None).cast("bigint").alias("ingest_session_id"),
    )


@query(
    PRELUDE + _PLAN + f""", old AS (SELECT max(id) AS top FROM plan)
  SELECT CASE WHEN action = 'created' THEN (SELECT top FROM old) + row_number() OVER (PARTITION BY action ORDER BY source_path) ELSE id END AS id,
    source_path, content_hash, CASE action WHEN 'unchanged' THEN 'Doc ' || source_path ELSE 'Doc ' || source_path || ' v2' END AS title,
    CASE action WHEN 'unchanged' THEN 'generic' ELSE 'faq' END AS doc_type, CASE action WHEN 'updated' THEN 2 ELSE 1 END AS version,
    CASE WHEN action = 'unchanged' OR length(text) % 2 = 1 THEN 'pending' ELSE 'done' END AS extraction_status,
    CASE WHEN action = 'created' THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS created_at,
    CASE WHEN action <> 'unchanged' AND length(text) % 2 = 0 THEN {AS_OF} END AS extracted_at,
    CASE WHEN action <> 'created' THEN 7 END AS ingest_session_id FROM plan"""
)
def apply_documents(t: Tables) -> DataFrame:
    after = V.apply_documents(t.current_documents(), _planned(t), _moment())
    return after.select(
        "id", "source_path", "content_hash", "title", "doc_type", "version", "extraction_status", "created_at",
        "extracted_at", "ingest_session_id",
    )


@query(
    # the chunks of all documents as they read after the second load
    PRELUDE.replace(
        "FROM documents WHERE length(text)",
        "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM documents) WHERE length(text)",
    )
    + "SELECT document_id, chunk_index, md5(content) AS content FROM base_chunks"
)
def replace_chunks(t: Tables) -> DataFrame:
    current = chunk_documents(t.current_documents())
    planned = V.plan_ingest(t.incoming_documents(), t.current_documents())
    changed = planned.filter("action <> 'unchanged'").withColumn("id", F.col("source_path").cast("bigint"))
    fresh = chunk_documents(
        changed.select("id", F.col("text").alias("raw_content"), F.lit("generic").alias("doc_type"), F.lit("{}").alias("attributes"))
    )
    after = V.replace_chunks(current, changed.select(F.col("id").alias("document_id")), fresh)
    return after.withColumn("content", F.md5("content"))


# --- mentions, relations, links ------------------------------------------------------------------


def _changed_orders(t: Tables) -> DataFrame:
    return t.raw("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"))


_URGENT = "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(
    PRELUDE + f"""SELECT entity_id, document_id, role, valid_from,
    CASE WHEN invalid_at IS NULL AND document_id IN {_URGENT} THEN {AS_OF} ELSE invalid_at END AS invalid_at FROM base_mentions
  UNION ALL SELECT DISTINCT l_suppkey * 8 + 3, l_orderkey, CASE WHEN l_linenumber > 3 THEN 'owner' END, {AS_OF}, CAST(NULL AS TIMESTAMP)
  FROM lineitem WHERE l_orderkey IN {_URGENT}"""
)
def replace_mentions(t: Tables, current: DataFrame | None = None) -> DataFrame:
    wanted = t.raw("lineitem").withColumnRenamed("l_orderkey", "document_id").join(
        _changed_orders(t), "document_id", "left_semi"
    ).select(
        (F.col("l_suppkey") * 8 + 3).alias("entity_id"), "document_id", F.when(F.col("l_linenumber") > 3, "owner").alias("role")
    )
    return V.replace_mentions(t.mentions() if current is None else current, _changed_orders(t), wanted, _moment())


@query(
    PRELUDE + f""", wanted AS (SELECT DISTINCT l_suppkey * 8 + 3 AS source_id,
    CASE WHEN l_linenumber = 1 THEN l_suppkey * 8 + 3 ELSE (l_partkey // 2) * 8 + 5 END AS target_id,
    'related_to' AS relation, l_orderkey AS document_id FROM lineitem WHERE l_orderkey IN {_URGENT}),
  w AS (SELECT * FROM wanted WHERE source_id <> target_id)
  SELECT r.source_id, r.target_id, r.relation, r.document_id, CASE WHEN w.source_id IS NOT NULL THEN {AS_OF} ELSE r.valid_from END AS valid_from,
    CASE WHEN w.source_id IS NOT NULL THEN NULL WHEN r.invalid_at IS NULL AND r.document_id IN {_URGENT} THEN {AS_OF} ELSE r.invalid_at END AS invalid_at
  FROM base_relations r LEFT JOIN w USING (source_id, target_id, relation, document_id)
  UNION ALL SELECT w.*, {AS_OF}, NULL FROM w ANTI JOIN base_relations USING (source_id, target_id, relation, document_id)"""
)
def replace_relations(t: Tables, current: DataFrame | None = None) -> DataFrame:
    supplier = F.col("l_suppkey") * 8 + 3
    part = F.floor(F.col("l_partkey") / 2) * 8 + 5
    wanted = t.raw("lineitem").withColumnRenamed("l_orderkey", "document_id").join(
        _changed_orders(t), "document_id", "left_semi"
    ).select(
        supplier.alias("source_id"), F.when(F.col("l_linenumber") == 1, supplier).otherwise(part).alias("target_id"),
        F.lit("related_to").alias("relation"), "document_id",
    )
    return V.replace_relations(t.relations() if current is None else current, _changed_orders(t), wanted, _moment())


_RELINKED = f""", ch AS (SELECT id FROM base_documents WHERE doc_type IN ('faq', 'generic')),
closed AS (SELECT source_id, target_id, kind, valid_from, CASE WHEN invalid_at IS NULL AND source_id IN (SELECT id FROM ch) THEN {AS_OF} ELSE invalid_at END AS invalid_at FROM base_links),
names AS (SELECT * FROM base_link_names WHERE source_id IN (SELECT id FROM ch)),
matched AS (SELECT DISTINCT n.source_id, n.name, (SELECT min(d.id) FROM base_documents d WHERE d.source_path = n.name OR lower(d.title) = lower(n.name)) AS target_id FROM names n),
waiting AS (SELECT p.*, (SELECT min(d.id) FROM base_documents d WHERE d.id IN (SELECT id FROM ch) AND (d.source_path = p.target_name OR lower(d.title) = lower(p.target_name))) AS target_id
  FROM base_pending p WHERE p.source_id NOT IN (SELECT id FROM ch)),
w AS (SELECT DISTINCT source_id, target_id, 'reference' AS kind FROM (SELECT source_id, target_id FROM matched UNION ALL SELECT source_id, target_id FROM waiting) WHERE target_id <> source_id)"""


def _relinked(t: Tables) -> tuple[DataFrame, DataFrame]:
    changed = t.documents().filter(F.col("doc_type").isin("faq", "generic")).select(F.col("id").alias("document_id"))
    names = t.link_names().join(changed.select(F.col("document_id").alias("source_id")), "source_id", "left_semi")
    return V.replace_links(t.links(), t.pending_links(), changed, names, t.documents(), _moment())


@query(
    PRELUDE + _RELINKED + f"""SELECT c.source_id, c.target_id, c.kind, CASE WHEN c.invalid_at IS NULL AND w.source_id IS NOT NULL THEN {AS_OF} ELSE c.valid_from END AS valid_from, c.invalid_at
  FROM closed c LEFT JOIN w USING (source_id, target_id, kind)
  UNION ALL SELECT w.*, {AS_OF}, NULL FROM w ANTI JOIN (SELECT * FROM closed WHERE invalid_at IS NULL) c USING (source_id, target_id, kind)"""
)
def replace_links(t: Tables) -> DataFrame:
    return _relinked(t)[0]


@query(
    PRELUDE + _RELINKED + """SELECT source_id, target_name, kind FROM waiting WHERE target_id IS NULL
  UNION SELECT source_id, name, 'reference' FROM matched WHERE target_id IS NULL"""
)
def pending_after_links(t: Tables) -> DataFrame:
    return _relinked(t)[1]


@query(
    PRELUDE + """SELECT id FROM base_entities WHERE id IN (SELECT entity_id FROM base_mentions)
  OR id IN (SELECT source_id FROM base_relations) OR id IN (SELECT target_id FROM base_relations)"""
)
def drop_orphans(t: Tables) -> DataFrame:
    return V.drop_orphans(t.entities(), t.mentions(), t.relations()).select("id")


# --- facts ------------------------------------------------------------------------------------

_NEW_FACTS = """new_facts AS (SELECT event_id + 100000000 AS id, event_type || '-' || (user_id % 7) AS topic, 'new ' || props AS content,
  ts + INTERVAL 45 DAY AS valid_from, user_id AS created_by, event_id // 20 AS session_id FROM events WHERE event_type <> 'view')"""


def _new_facts(t: Tables) -> DataFrame:
    return t.events().filter("event_type <> 'view'").select(
        (F.col("event_id") + 100_000_000).alias("id"), F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("topic"),
        F.concat(F.lit("new "), "props").alias("content"), (F.col("ts") + F.expr("INTERVAL 45 DAYS")).alias("valid_from"),
        F.col("user_id").alias("created_by"), F.floor(F.col("event_id") / 20).alias("session_id"),
    )


@query(
    PRELUDE + f""", {_NEW_FACTS}
  SELECT id, topic, content, valid_from, least(invalid_at, lead(valid_from) OVER (PARTITION BY topic ORDER BY valid_from, id)) AS invalid_at
  FROM (SELECT id, topic, content, valid_from, invalid_at FROM base_facts UNION ALL SELECT id, topic, content, valid_from, NULL FROM new_facts)"""
)
def upsert_facts(t: Tables, current: DataFrame | None = None) -> DataFrame:
    return V.upsert_facts(t.facts() if current is None else current, _new_facts(t)).select("id", "topic", "content", "valid_from", "invalid_at")


@query(
    PRELUDE + f"""SELECT id, topic, CASE WHEN invalid_at IS NULL AND starts_with(topic, 'click') THEN {AS_OF} ELSE invalid_at END AS invalid_at
  FROM base_facts WHERE NOT starts_with(topic, 'error')"""
)
def delete_facts(t: Tables) -> DataFrame:
    """Soft deletion of one family of topics and hard deletion of another."""
    topics = t.facts().select("topic").distinct()
    soft = V.soft_delete(t.facts(), topics.filter(F.col("topic").startswith("click")), _moment())
    return V.hard_delete(soft, topics.filter(F.col("topic").startswith("error"))).select("id", "topic", "invalid_at")


@query(PRELUDE + f"SELECT id, topic FROM base_facts WHERE valid_from <= {AS_OF} AND (invalid_at IS NULL OR invalid_at > {AS_OF})")
def facts_as_of(t: Tables) -> DataFrame:
    return V.as_of(t.facts(), _moment()).select("id", "topic")


# --- re-extraction and checks -------------------------------------------------------------------


def _extracted(t: Tables) -> DataFrame:
    return X.normalize_extractions(t.raw_extractions()).withColumn("model", F.lit("m2"))


@query(
    PRELUDE + f"""SELECT document_id AS id, doc_type, status AS extraction_status, 'm2' AS extraction_model, {AS_OF} AS extracted_at FROM base_extractions"""
)
def reextract(t: Tables) -> DataFrame:
    return V.reextract(t.documents(), _extracted(t), _moment()).select(
        "id", "doc_type", "extraction_status", "extraction_model", "extracted_at"
    )


@query(
    PRELUDE + f"""SELECT id, CASE WHEN l.doc_id IS NULL THEN d.doc_type ELSE 'faq' END AS doc_type,
    CASE WHEN l.doc_id IS NULL THEN extraction_status WHEN e.doc_type = 'faq' THEN e.status ELSE 'skipped' END AS extraction_status,
    CASE WHEN l.doc_id IS NULL THEN extraction_model WHEN e.doc_type = 'faq' THEN 'm2' END AS extraction_model,
    CASE WHEN l.doc_id IS NOT NULL AND e.doc_type <> 'faq' THEN '{{}}' END AS cleared
  FROM base_documents d JOIN base_extractions e ON e.document_id = d.id LEFT JOIN labels l ON l.doc_id = d.id"""
)
def set_type(t: Tables) -> DataFrame:
    overrides = t.raw("labels").select(F.col("doc_id").alias("document_id"), F.lit("faq").alias("doc_type"))
    after = V.set_type(t.documents(), overrides, _extracted(t), _moment())
    return after.select(
        "id", "doc_type", "extraction_status", "extraction_model", F.when(F.col("attributes") == "{}", "{}").alias("cleared")
    )


@query(
    PRELUDE + """, again AS (SELECT id FROM base_documents WHERE id % 40 = 3)
  SELECT 'documents: one row per source path' AS rule, (SELECT count(*) FROM again) AS violations
  UNION ALL SELECT 'documents: status', (SELECT count(*) FROM base_documents WHERE id % 50 = 7) + (SELECT count(*) FROM again WHERE id % 50 = 7)
  UNION ALL SELECT 'documents: source kind', (SELECT count(*) FROM base_documents WHERE id % 60 = 11) + (SELECT count(*) FROM again WHERE id % 60 = 11)
  UNION ALL SELECT 'entities: one row per name', (SELECT count(*) FROM base_entities WHERE id % 16 = 3)
  UNION ALL SELECT 'mentions: one active row per role', (SELECT count(*) FROM base_mentions WHERE invalid_at IS NULL AND document_id % 9 = 1)
  UNION ALL SELECT 'relations: one row per edge', (SELECT count(*) FROM base_relations WHERE document_id % 9 = 1)
  UNION ALL SELECT 'relations: no self edges', (SELECT count(*) FROM base_relations WHERE document_id % 9 = 1)
  UNION ALL SELECT 'links: one active row per kind', (SELECT count(*) FROM base_links WHERE invalid_at IS NULL AND source_id % 9 = 1)
  UNION ALL SELECT 'links: no self links', (SELECT count(*) FROM base_links WHERE source_id % 9 = 1)
  UNION ALL SELECT 'facts: one active version per topic', (SELECT count(DISTINCT topic) FROM base_facts WHERE invalid_at IS NULL)
  UNION ALL SELECT 'sessions: one active per user', (SELECT count(DISTINCT user_id) FROM base_sessions WHERE active)
  UNION ALL SELECT 'messages: role', (SELECT count(*) FROM conversations WHERE role NOT IN ('user', 'assistant'))"""
)
def integrity_report(t: Tables) -> DataFrame:
    """The tables with broken rows for every rule: some rows twice, unknown values, edges to themselves."""
    n = F.col("id")
    documents = t.documents()
    documents = documents.unionByName(documents.where(n % 40 == 3)).withColumns(
        {
            "extraction_status": F.when(n % 50 == 7, "lost").otherwise(F.col("extraction_status")),
            "source_kind": F.when(n % 60 == 11, "fax").otherwise(F.col("source_kind")),
        }
    )
    entities, mentions, relations, links = t.entities(), t.mentions(), t.relations(), t.links()
    facts, sessions = t.facts(), t.sessions()
    edge, link = relations.where(F.col("document_id") % 9 == 1), links.where(F.col("source_id") % 9 == 1)
    loop = F.col("source_id")
    return V.integrity_report(
        {
            "documents": documents,
            "entities": entities.unionByName(entities.where(n % 16 == 3)),
            "mentions": mentions.unionByName(mentions.where(F.col("document_id") % 9 == 1)),
            "relations": relations.unionByName(edge).unionByName(
                edge.withColumns({"target_id": loop, "document_id": -F.monotonically_increasing_id()})
            ),
            "links": links.unionByName(link).unionByName(
                link.withColumns({"target_id": loop, "kind": F.concat("kind", F.lit(" to itself"))})
            ),
            "facts": facts.unionByName(facts),
            "sessions": sessions.unionByName(sessions),
            "messages": t.raw("conversations"),
        }
    )
