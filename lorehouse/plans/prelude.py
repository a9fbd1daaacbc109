"""The derived tables of ``views.Tables`` as SQL common table expressions."""

AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"

_TYPES = "['generic','regulation','instruction','faq','meeting_notes']"

PRELUDE = rf"""
WITH RECURSIVE base_documents AS (
  SELECT doc_id AS id, 'Doc ' || doc_id AS title, source || '/' || doc_id AS source_path,
    CASE WHEN doc_id % 4 = 0 THEN 'url' ELSE 'file' END AS source_kind,
    text AS raw_content, sha256(text) AS content_hash, 1 AS version,
    {_TYPES}[doc_id % 5 + 1] AS doc_type,
    '{{"lang":"' || lang || '","owner":"' || source || '","status":"' ||
      ['active','draft','deprecated'][doc_id % 3 + 1] || '","review_by":"' ||
      CASE WHEN doc_id % 6 = 0 THEN 'soon' ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) AS VARCHAR) END ||
      '","n_chars":' || n_chars || ',"tags":["' || lang || '","t' || (doc_id % 7) || '"],"meta":{{"bucket":' ||
      (doc_id % 10) || '}}}}' AS attributes,
    ['pending','failed','skipped','done','done','done','done'][doc_id % 7 + 1] AS extraction_status,
    CASE doc_id % 3 WHEN 1 THEN 'model-a' WHEN 2 THEN 'model-b' END AS extraction_model,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS created_at,
    CASE WHEN doc_id % 3 = 0 THEN doc_id // 3 END AS ingest_session_id, lang, source
  FROM documents
), base_entities AS (
  SELECT *, lower(trim(name)) AS canonical FROM (
    SELECT CAST(r_regionkey AS BIGINT) * 8 + 1 AS id, 'department' AS entity_type, r_name AS name FROM region
    UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, 'project', n_name FROM nation
    UNION ALL SELECT s_suppkey * 8 + 3, 'person', s_name FROM supplier
    UNION ALL SELECT c_custkey * 8 + 4, 'person', c_name FROM customer
    UNION ALL SELECT p_partkey * 8 + 5, 'product', p_name || ' ' || p_partkey FROM part)
), base_relations AS (
  SELECT s_suppkey * 8 + 3 AS source_id, CAST(s_nationkey AS BIGINT) * 8 + 2 AS target_id, 'part_of' AS relation,
    s_suppkey AS document_id, TIMESTAMP '1995-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS invalid_at FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, CAST(n_regionkey AS BIGINT) * 8 + 1, 'part_of',
    CAST(n_nationkey AS BIGINT), TIMESTAMP '1995-01-01', NULL FROM nation
  UNION ALL SELECT c_custkey * 8 + 4, CAST(c_nationkey AS BIGINT) * 8 + 2, 'reports_to', c_custkey,
    TIMESTAMP '1995-01-01', CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '1998-01-01' END FROM customer
  UNION ALL SELECT l_suppkey * 8 + 3, l_partkey * 8 + 5, 'related_to', l_orderkey, TIMESTAMP '1995-01-01',
    CASE WHEN min(l_returnflag) = 'R' THEN max(l_shipdate) END FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey
), base_mentions AS (
  SELECT l_suppkey * 8 + 3 AS entity_id, l_orderkey AS document_id,
    CASE l_returnflag WHEN 'A' THEN 'owner' WHEN 'R' THEN 'approver' END AS role,
    min(l_shipdate) AS valid_from,
    CASE WHEN max(l_linestatus) = 'F' THEN max(l_shipdate) + INTERVAL 30 DAY END AS invalid_at
  FROM lineitem GROUP BY 1, 2, 3
), base_links AS (
  SELECT id AS source_id, id // 2 AS target_id,
    CASE WHEN id % 11 = 0 THEN 'supersedes' WHEN id % 5 = 0 THEN 'attachment' ELSE 'reference' END AS kind,
    created_at AS valid_from, CASE WHEN id % 13 = 0 THEN {AS_OF} END AS invalid_at
  FROM base_documents WHERE id <> id // 2
), base_link_names AS (
  SELECT id AS source_id, CASE id % 4 WHEN 0 THEN 'DOC ' || (id // 3) WHEN 1 THEN source || '/' || id
    WHEN 2 THEN 'doc ' || (id + 100000000) ELSE 'doc ' || (id // 3) END AS name
  FROM base_documents
), base_pending AS (
  SELECT id AS source_id, CASE WHEN id % 2 = 0 THEN 'dOc ' || (id + 1) ELSE 'nothing ' || id END AS target_name,
    'reference' AS kind FROM base_documents
), base_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), base_users AS (
  SELECT DISTINCT user_id AS id, user_id + 1000 AS telegram_id, 'user ' || (user_id % 40) AS name FROM events
), base_messages AS (
  SELECT event_id AS id, user_id AS conversation_id, event_type, value, k, ts AS created_at,
    '{{' || CASE WHEN event_type = 'signup' THEN '' ELSE '"model":"' || event_type || '",' END ||
    CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN '"cost":null,' ELSE '"cost":' || value || ',' END ||
    '"prompt_tokens":' || k || ',"completion_tokens":' || (event_id % 100) || ',"total_tokens":' ||
    (k + event_id % 100) || ',"prompt_tokens_details":{{"cached_tokens":' || (k % 10) ||
    '}},"cache_write_tokens":' || (k % 3) || ',"cache_creation_input_tokens":' || (k % 5) || '}}' AS usage
  FROM base_events
), base_facts AS (
  SELECT event_id AS id, event_type || '-' || (user_id % 10) AS topic, props AS content, ts AS valid_from,
    lead(ts) OVER (PARTITION BY event_type || '-' || (user_id % 10) ORDER BY ts, event_id) AS invalid_at,
    user_id AS created_by, event_id // 20 AS session_id
  FROM events
), base_buffered AS (
  SELECT event_id // 20 AS session_id, event_id % 20 + 1 AS seq, event_type || ' ' || props AS text, ts FROM events
), base_sessions AS (
  SELECT event_id // 20 AS id, min(user_id) AS user_id, min(ts) AS started_at, max(ts) AS last_active_at,
    (event_id // 20) % 3 = 0 AS active
  FROM events GROUP BY event_id // 20
), base_session_events AS (
  SELECT user_id, ts, event_id AS id, CASE WHEN event_type = 'signup' THEN 'toggle'
    WHEN event_type IN ('click', 'error') THEN 'text' ELSE 'document' END AS kind,
    event_type || ' ' || props AS text
  FROM events
), base_states AS (
  SELECT *, sum(CASE WHEN kind = 'toggle' THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id, segment ORDER BY ts, id) AS toggles
  FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, id) AS segment
    FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1440 MINUTE THEN 1 ELSE 0 END AS brk,
        lead(ts) OVER w AS next_at
      FROM base_session_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)))
), base_first_load AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_path, 1 AS seq, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)
), base_second_load AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_path, 2 AS seq,
    CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM documents
), base_attempts AS (
  SELECT doc_id, 1 AS attempt,
    CASE WHEN doc_id % 10 = 0 THEN 'junk' WHEN doc_id % 10 = 1 THEN 'junk' WHEN doc_id % 10 = 2 THEN 'error' ELSE 'object' END AS answer,
    CASE doc_id % 7 WHEN 0 THEN 0.3 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.75 END AS confidence,
    ['generic','regulation','instruction','faq','meeting_notes','generic'][doc_id % 6 + 1] AS claimed, lang, source
  FROM documents
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 20 = 0 THEN 'junk' ELSE 'object' END, 0.8,
    ['generic','regulation','instruction','faq','meeting_notes','generic'][(doc_id + 1) % 6 + 1], lang, source
  FROM documents
), base_judged AS (
  SELECT *, answer = 'object' AND (confidence < 0.6 OR NOT (
      (claimed = 'regulation' AND (doc_id % 5 = 0 OR doc_id % 8 = 0)) OR
      (claimed = 'meeting_notes' AND doc_id % 11 = 0))) AS accepted
  FROM base_attempts
), base_extractions AS (
  SELECT doc_id AS document_id, lang, source,
    CASE WHEN bool_or(accepted) THEN 'done' ELSE 'failed' END AS status,
    CASE WHEN NOT bool_or(accepted) OR arg_min(confidence, attempt) FILTER (WHERE accepted) < 0.6 THEN 'generic'
      ELSE arg_min(claimed, attempt) FILTER (WHERE accepted) END AS doc_type,
    CASE WHEN bool_or(accepted) THEN CAST(arg_min(confidence, attempt) FILTER (WHERE accepted) AS DOUBLE) ELSE 0.0 END AS confidence,
    bool_or(accepted) AND arg_min(confidence, attempt) FILTER (WHERE accepted) >= 0.6 AS with_attributes,
    bool_or(accepted) OR arg_max(answer, attempt) FILTER (WHERE answer <> 'error') = 'object' AS with_envelope
  FROM base_judged GROUP BY doc_id, lang, source
), ch_words AS (
  SELECT doc_id, unnest(list) AS w, generate_subscripts(list, 1) AS i
  FROM (SELECT doc_id, string_split_regex(trim(text, ' ' || chr(10)), '\s+') AS list FROM documents WHERE length(text) > 1500)
), ch_ends AS (
  SELECT doc_id, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e,
    count(*) OVER (PARTITION BY doc_id) AS n FROM ch_words
), ch_jumps AS (
  SELECT a.doc_id, a.i, a.n, greatest(coalesce(b.i, a.n + 1), a.i + 1) AS j
  FROM ch_ends a ASOF LEFT JOIN ch_ends b ON a.doc_id = b.doc_id AND a.e - length(a.w) - 1 + 1501 < b.e
), ch_pieces AS (
  SELECT doc_id, 0 AS p, CAST(1 AS BIGINT) AS a, j AS b, n FROM ch_jumps WHERE i = 1
  UNION ALL
  SELECT c.doc_id, c.p + 1, c.b, x.j, x.n FROM ch_pieces c JOIN ch_jumps x ON x.doc_id = c.doc_id AND x.i = c.b
), base_chunks AS (
  SELECT doc_id AS document_id, 0 AS chunk_index, trim(text, ' ' || chr(10)) AS content, doc_id * 1000000 AS chunk_id
  FROM documents WHERE length(text) <= 1500 AND trim(text, ' ' || chr(10)) <> ''
  UNION ALL
  SELECT p.doc_id, p.p, string_agg(w, ' ' ORDER BY i), p.doc_id * 1000000 + p.p
  FROM ch_pieces p JOIN ch_ends e ON e.doc_id = p.doc_id AND e.i >= p.a AND e.i < p.b GROUP BY p.doc_id, p.p
), base_tokens AS (
  SELECT chunk_id, unnest(list) AS term, generate_subscripts(list, 1) - 1 AS position
  FROM (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS list FROM base_chunks)
), base_cells AS (
  SELECT chunk_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n
  FROM base_tokens GROUP BY 1, 2
), base_vectors AS (
  SELECT chunk_id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS FLOAT) AS DOUBLE) AS weight
  FROM base_cells
), base_query_words AS (
  SELECT item_id AS query_id, list, regexp_extract_all(lower('Represent the query for retrieving supporting documents: ' || text),
    '[\p{{L}}\p{{N}}_]+') AS embedded
  FROM (SELECT item_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS list FROM benchmark)
), base_query_vectors AS (
  SELECT query_id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS weight
  FROM (SELECT query_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n
    FROM (SELECT query_id, unnest(embedded) AS term FROM base_query_words) GROUP BY 1, 2)
), base_vector_scores AS (
  SELECT query_id, chunk_id, round(dot / (qn * cn), 9) AS score FROM (
    SELECT q.query_id, c.chunk_id, sum(q.weight * c.weight) AS dot FROM base_query_vectors q
    JOIN base_vectors c USING (bucket) GROUP BY 1, 2)
  JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM base_query_vectors GROUP BY 1) USING (query_id)
  JOIN (SELECT chunk_id, sqrt(sum(weight * weight)) AS cn FROM base_vectors GROUP BY 1) USING (chunk_id)
), base_vector_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM base_vector_scores
  QUALIFY rank <= 20
), base_query_terms AS (
  SELECT DISTINCT query_id, unnest(list) AS term FROM base_query_words
), base_and_matches AS (
  SELECT query_id, chunk_id FROM base_query_terms JOIN (SELECT DISTINCT chunk_id, term FROM base_tokens) USING (term)
  GROUP BY 1, 2 HAVING count(*) = any_value((SELECT count(*) FROM base_query_terms t WHERE t.query_id = base_query_terms.query_id))
), base_entries AS (
  SELECT m.query_id, m.chunk_id, t.term, t.position,
    row_number() OVER (PARTITION BY m.query_id, m.chunk_id ORDER BY t.position) AS ord
  FROM base_and_matches m JOIN base_tokens t ON t.chunk_id = m.chunk_id
  JOIN base_query_terms q ON q.query_id = m.query_id AND q.term = t.term
), base_lasts AS (
  SELECT e.query_id, e.chunk_id, e.ord, e.position, q.term,
    max(CASE WHEN e.term = q.term THEN e.ord END)
      OVER (PARTITION BY e.query_id, e.chunk_id, q.term ORDER BY e.ord) AS last_ord
  FROM base_entries e JOIN base_query_terms q ON q.query_id = e.query_id
), base_windows AS (
  SELECT query_id, chunk_id, ord, any_value(position) AS stop_at, min(last_ord) AS start_ord
  FROM base_lasts GROUP BY 1, 2, 3 HAVING count(*) = count(last_ord)
), base_covers AS (
  SELECT query_id, chunk_id, start_ord, min(ord) AS stop_ord, min(stop_at) AS stop_at
  FROM base_windows GROUP BY 1, 2, 3
), base_lexical_top AS (
  SELECT c.query_id, c.chunk_id,
    round(sum(0.1 / (1 + (c.stop_at - s.position) - (c.stop_ord - c.start_ord))), 9) AS score,
    row_number() OVER (PARTITION BY c.query_id ORDER BY
      round(sum(0.1 / (1 + (c.stop_at - s.position) - (c.stop_ord - c.start_ord))), 9) DESC, c.chunk_id) AS rank
  FROM base_covers c JOIN base_entries s ON s.query_id = c.query_id AND s.chunk_id = c.chunk_id AND s.ord = c.start_ord
  GROUP BY c.query_id, c.chunk_id QUALIFY rank <= 20
), base_fused AS (
  SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first_seen FROM (
    SELECT query_id, chunk_id, rank, 0 AS list FROM base_vector_top
    UNION ALL SELECT query_id, chunk_id, rank, 1 FROM base_lexical_top) GROUP BY 1, 2
), base_found AS (
  SELECT query_id, chunk_id, round(score, 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_seen) AS place FROM base_fused
  QUALIFY place <= 4
)
"""
