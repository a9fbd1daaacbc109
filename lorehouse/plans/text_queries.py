"""Sources, text functions, URL rules, filters and chunking."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.functions import jsonb
from lorehouse.functions import text as X
from lorehouse.operators import filters
from lorehouse.operators.chunking import chunk_documents
from lorehouse.plans.catalog import query
from lorehouse.plans.prelude import AS_OF, PRELUDE
from lorehouse.plans.views import AS_OF as MOMENT
from lorehouse.plans.views import Tables
from lorehouse.session import fresh_path
from lorehouse.sources import pages as P
from lorehouse.sources import readers as R
from lorehouse.sources import urls as U

_CANONICAL = r"""
lower(regexp_extract(url, '^([^:]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([^:]+)://([^/?#]*)', 2)) ||
regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
  lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')), '&'), ''), '')
"""

_UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"

_DROP = "html"
for _tag in ("script", "style", "noscript", "nav", "header", "footer", "aside", "title"):
    _DROP = rf"regexp_replace({_DROP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', chr(10), 'g')"
_DROP = _DROP.replace("(html,", "(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),", 1)
_BLOCKS = rf"regexp_replace({_DROP}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|main|body|html|head|blockquote|pre)\b[^>]*>', chr(10), 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_BLOCKS}, '(?s)<[A-Za-z/!][^>]*>', '', 'g'), '[ \t]+', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_PLAIN}, ' ?\n\s*', chr(10), 'g'), ' ' || chr(10))"


@query(
    f"""SELECT page_id, {_CANONICAL} AS source_path,
  coalesce(nullif(trim({_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), ''), {_CANONICAL}) AS title,
  trim({_UNESCAPE.format(_TEXT)}, ' ' || chr(10)) AS text, 'url' AS source_kind FROM pages
  WHERE trim({_TEXT}, ' ' || chr(10)) <> ''"""
)
def extract_pages(t: Tables) -> DataFrame:
    return P.extract_pages(t.raw("pages"))[0]


@query(f"SELECT page_id, {_CANONICAL} AS canonical FROM pages")
def canonical_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


_POLICY_URLS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://10.' || (page_id % 200) || '.0.1/x'
  WHEN 2 THEN 'ftp://host/' || page_id WHEN 3 THEN 'http://8.8.4.' || (page_id % 200) || ':80/'
  WHEN 4 THEN 'http://user@169.254.' || (page_id % 200) || '.1/' ELSE 'http://[fe80::' || (page_id % 9) || ']/' END AS url FROM pages"""


@query(
    f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) WHEN 1 THEN '10.' || (page_id % 200) || '.0.1'
    WHEN 2 THEN 'host' WHEN 3 THEN '8.8.4.' || (page_id % 200) WHEN 4 THEN '169.254.' || (page_id % 200) || '.1'
    ELSE 'fe80::' || (page_id % 9) END AS host,
  CASE page_id % 6 WHEN 1 THEN 'blocked address' WHEN 2 THEN 'scheme' WHEN 4 THEN 'blocked address' WHEN 5 THEN 'blocked address' END AS reject_reason
  FROM ({_POLICY_URLS})"""
)
def url_policy(t: Tables) -> DataFrame:
    n = F.col("page_id")
    url = (
        F.when(n % 6 == 0, F.col("url"))
        .when(n % 6 == 1, F.concat(F.lit("http://10."), n % 200, F.lit(".0.1/x")))
        .when(n % 6 == 2, F.concat(F.lit("ftp://host/"), n))
        .when(n % 6 == 3, F.concat(F.lit("http://8.8.4."), n % 200, F.lit(":80/")))
        .when(n % 6 == 4, F.concat(F.lit("http://user@169.254."), n % 200, F.lit(".1/")))
        .otherwise(F.concat(F.lit("http://[fe80::"), n % 9, F.lit("]/")))
    )
    crawl = t.raw("pages").select(n, url.alias("url"))
    return U.url_policy(crawl).select("page_id", "host", "reject_reason")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'http://a.b/' || conv_id || ' ' || 'HTTPS://c.d/' || turn
  END AS urls, turn % 3 <> 2 AS first_is_url FROM conversations"""
)
def message_urls(t: Tables) -> DataFrame:
    c, n = F.col("conv_id"), F.col("turn")
    links = F.concat(F.lit(" http://a.b/"), c, F.lit("\n HTTPS://c.d/"), n)
    message = (
        F.when(n % 3 == 0, links).when(n % 3 == 1, F.concat(links, F.lit(" "), "text")).otherwise(F.concat(F.lit("see "), "text", links))
    )
    first = F.try_element_at(X.words(message), F.lit(1))
    return t.raw("conversations").select(
        "conv_id", "turn", F.array_join(X.message_urls(message), " ").alias("urls"),
        X.looks_like_url(first).alias("first_is_url"),
    )


@query(
    r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Page ' || page_id || '.MD' WHEN page_id % 4 = 1 THEN 'a.b.html'
  WHEN page_id % 4 = 2 THEN 'tool.exe' ELSE '.hidden' END AS name,
  ['Page ' || page_id, 'a.b', 'tool', '.hidden'][page_id % 4 + 1] AS stem,
  ['.md', '.html', '.exe', ''][page_id % 4 + 1] AS suffix,
  CASE WHEN page_id % 4 >= 2 THEN 'unsupported type' WHEN length(html) * 4000 > 20971520 THEN 'too large' END AS reject_reason
  FROM pages"""
)
def filter_supported(t: Tables) -> DataFrame:
    n = F.col("page_id")
    name = (
        F.when(n % 4 == 0, F.concat(F.lit("Page "), n, F.lit(".MD"))).when(n % 4 == 1, "a.b.html")
        .when(n % 4 == 2, "tool.exe").otherwise(".hidden")
    )
    files = t.raw("pages").select(
        n, F.concat(F.lit("/data/x.y/"), name).alias("path"), (F.length("html") * 4000).alias("length")
    )
    return R.filter_supported(files).select(
        "page_id", R.file_name(F.col("path")).alias("name"), R.file_stem(F.col("path")).alias("stem"),
        R.file_suffix(F.col("path")).alias("suffix"), "reject_reason",
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'tg:' || user_id || ':' || lower('Плaн ' || props || '.PDF')
  ELSE 'file:' || user_id || ':' || 'Плaн ' || props || '.PDF' END AS source_path FROM events"""
)
def upload_paths(t: Tables) -> DataFrame:
    origin = F.when(F.col("event_type") == "view", "telegram").otherwise("web")
    name = F.concat(F.lit("Плaн "), "props", F.lit(".PDF"))
    return t.raw("events").select(
        "event_id", R.upload_source_path(origin, F.col("user_id"), name).alias("source_path")
    )


@query(
    f"""SELECT 'loaded' AS outcome, 'url' AS source_kind, count(*) AS n, CAST(sum(length(trim({_UNESCAPE.format(_TEXT)}, ' ' || chr(10)))) AS BIGINT) AS chars FROM pages WHERE {_TEXT} <> ''
  UNION ALL SELECT 'loaded', 'file', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents WHERE doc_id % 3 <> 2
  UNION ALL SELECT 'unsupported type', NULL, count(*), NULL FROM documents WHERE doc_id % 3 = 2
  UNION ALL SELECT 'no text', NULL, count(*), NULL FROM pages WHERE {_TEXT} = '' HAVING count(*) > 0"""
)
def bulk_load(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    ending = F.when(n % 3 == 0, ".txt").when(n % 3 == 1, ".md").otherwise(".bin")
    files = t.raw("documents").select(
        F.concat(F.lit("/in/"), n, ending).alias("path"), F.col("n_chars").alias("length"),
        F.col("text").alias("body"), F.lit(False).alias("is_url"),
    )
    web = t.raw("pages").select(
        F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"),
        F.col("html").alias("body"), F.lit(True).alias("is_url"),
    )
    loaded, rejected = R.bulk_load(files.unionByName(web))
    good = loaded.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(X.strip(F.col("text")))).alias("chars"))
    bad = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("loaded").alias("outcome"), "source_kind", "n", "chars").unionByName(
        bad.select(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("source_kind"), "n", F.lit(None).cast("bigint").alias("chars"))
    )


@query("SELECT doc_id, lang, length(text) AS chars FROM documents UNION ALL SELECT doc_id + 100000000, lang, 0 FROM documents")
def table_sink(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "sink")
    rows = t.raw("documents").select("doc_id", "lang", F.length("text").alias("chars"))
    R.write_table(rows, path, partition_by=["lang"])
    R.append_table(rows.select(F.col("doc_id") + 100_000_000, "lang", F.lit(0)).toDF("doc_id", "lang", "chars").repartition(1), f"{path}-more")
    return t.spark.read.parquet(path).select("doc_id", "lang", "chars").unionByName(
        t.spark.read.parquet(f"{path}-more")
    )


# --- text functions -----------------------------------------------------------------


@query(PRELUDE + "SELECT id, lower(trim('  ' || name || ' ')) AS canonical FROM base_entities")
def canonical_names(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("\t "), "name", F.lit(" "))
    return t.entities().select("id", X.canonical_name(padded).alias("canonical"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


_STOP = "['и','в','во','на','с','со','по','о','об','из','к','у','за','от','до','для','что','как','это','наш','наша','наши','мы','нас','the','a','an','of','to','and','or','for']"


@query(
    rf"""SELECT doc_id, coalesce(nullif(array_to_string((CASE WHEN len(good) > 0 THEN good ELSE words END)[1:4], '-'), ''), 'fakt') AS topic
  FROM (SELECT doc_id, words, list_filter(words, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)) AS good
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+') AS words FROM documents))"""
)
def topic_slugs(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.slugify_topic(F.col("text")).alias("topic"))


@query(
    """SELECT doc_id, length(text) // 4 AS tokens, length(text) // 4 >= 4096 AS cached,
  md5(CASE WHEN length(text) > 15000 THEN left(text, 12000) || chr(10) || '…' || chr(10) || right(text, 3000) ELSE text END) AS head_tail,
  md5(CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '…[усечено]' ELSE text END) AS body,
  length(text) > 8000 AS truncated FROM documents"""
)
def text_limits(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.raw("documents").select(
        "doc_id", X.estimate_tokens(text).alias("tokens"), X.worth_caching(text).alias("cached"),
        F.md5(X.head_tail(text)).alias("head_tail"), F.md5(X.truncate_body(text)).alias("body"),
        X.is_truncated(text).alias("truncated"),
    )


@query(
    r"""WITH RECURSIVE blocks AS (SELECT doc_id, unnest(list) AS b, generate_subscripts(list, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(trim(text, ' ' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS list FROM documents)),
  numbered AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM blocks),
  folded AS (
    SELECT doc_id, i, b, 1 AS part, CASE WHEN length(b) > 4000 THEN 0 ELSE length(b) END AS used, length(b) > 4000 AS cut FROM numbered WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, n.b,
      f.part + CASE WHEN length(n.b) > 4000 OR f.cut OR f.used + 2 + length(n.b) > 4000 THEN 1 ELSE 0 END,
      CASE WHEN length(n.b) > 4000 THEN 0 WHEN f.cut OR f.used + 2 + length(n.b) > 4000 THEN length(n.b) ELSE f.used + 2 + length(n.b) END,
      length(n.b) > 4000
    FROM folded f JOIN numbered n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
  pieces AS (
    SELECT doc_id, part, 0 AS slice, string_agg(b, chr(10) || chr(10) ORDER BY i) AS content FROM folded WHERE NOT cut GROUP BY doc_id, part
    UNION ALL SELECT doc_id, part, s, substr(b, s * 4000 + 1, 4000) FROM folded, unnest(range(0, (length(b) + 3999) // 4000)) u(s) WHERE cut)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, slice) - 1 AS place, md5(content) AS content FROM pieces"""
)
def split_messages(t: Tables) -> DataFrame:
    spaced = F.replace("text", F.lit("\n"), F.lit("\n \n"))
    return t.raw("documents").select(
        "doc_id", F.posexplode_outer(X.split_message(spaced)).alias("place", "content")
    ).filter(F.col("content").isNotNull()).withColumn("content", F.md5("content"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN k WHEN 'signup' THEN CAST(trunc(value) AS BIGINT) ELSE -1 END AS number,
  event_type = 'error' AS is_object FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def coerced_arguments(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", F.concat(F.lit('" '), "k", F.lit('"'))).when(kind == "signup", F.col("value").cast("string"))
        .when(kind == "view", "true").when(kind == "error", F.col("props")).otherwise('"1.5"')
    )
    return t.events().select(
        "event_id", X.coerce_int(value, -1).alias("number"),
        X.coerce_json_object(value).isNotNull().alias("is_object"),
    )


@query(
    """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'clarification' ELSE 'answered' END AS category,
  ['correct','partial','incorrect','unknown','false_refusal','correct_refusal'][(conv_id + turn * 3) % 6 + 1] AS verdict
  FROM conversations WHERE role = 'assistant'"""
)
def answer_labels(t: Tables) -> DataFrame:
    return t.answers().select(
        "conv_id", "turn", X.categorize_answer(F.col("answer")).alias("category"),
        X.parse_verdict(F.col("verdict_text")).alias("verdict"),
    )


@query(PRELUDE + "SELECT id, event_type <> 'view' AS has_cost, event_type <> 'signup' AS has_model FROM base_messages")
def usage_keys(t: Tables) -> DataFrame:
    usage = F.col("usage")
    return t.messages().select(
        "id", jsonb.key_exists(usage, "cost").alias("has_cost"), jsonb.key_exists(usage, "model").alias("has_model")
    )


# --- structured queries -----------------------------------------------------------------


@query(PRELUDE + """SELECT id FROM base_documents WHERE lang = 'en' AND id % 3 = 0 AND id % 7 = 2 AND id % 10 = 3""")
def filter_attributes(t: Tables) -> DataFrame:
    wanted = {"attributes": {"lang": "en", "status": "active", "tags": ["t2"], "meta": {"bucket": 3}}}
    return filters.filter_documents(t.documents(), wanted).select("id")


@query(PRELUDE + """SELECT id FROM base_documents WHERE title ILIKE '%OC _1%' AND doc_type = 'faq'""")
def filter_title_and_type(t: Tables) -> DataFrame:
    return filters.filter_documents(t.documents(), {"title_contains": "OC _1", "doc_type": "faq"}).select("id")


@query(PRELUDE + """SELECT id FROM base_documents WHERE CAST(created_at AS DATE) > DATE '2024-01-03' AND CAST(created_at AS DATE) < DATE '2024-02-01'""")
def filter_created(t: Tables) -> DataFrame:
    wanted = {"created_after": "2024-01-03", "created_before": "2024-02-01T05:00:00", "updated_after": None}
    return filters.filter_documents(t.documents(), wanted).select("id")


@query(PRELUDE + """SELECT id FROM base_documents WHERE id % 6 <> 0 AND DATE '2024-01-01' + CAST(id % 700 AS INTEGER) < DATE '2024-06-01'""")
def filter_attribute_date(t: Tables) -> DataFrame:
    return filters.filter_documents(t.documents(), {"review_by_before": "2024-06-01"}).select("id")


@query(
    PRELUDE + """SELECT DISTINCT d.id FROM base_documents d JOIN base_mentions m ON m.document_id = d.id
  JOIN base_entities e ON e.id = m.entity_id
  WHERE m.invalid_at IS NULL AND m.role = 'owner' AND e.canonical = 'supplier#000000003'"""
)
def filter_entity(t: Tables) -> DataFrame:
    wanted = {"entity": {"name": " SUPPLIER#000000003 ", "role": "owner"}}
    return filters.filter_documents(
        t.documents(), wanted, mentions=t.mentions(), entities=t.entities()
    ).select("id")


@query(
    PRELUDE + """SELECT id, title, doc_type, attributes, version, created_at FROM base_documents
  WHERE doc_type = 'regulation' ORDER BY created_at DESC, id DESC LIMIT 15"""
)
def query_documents(t: Tables) -> DataFrame:
    return filters.query_documents(t.documents(), {"doc_type": "regulation"})


@query(
    PRELUDE + """SELECT id, title, doc_type, version, created_at, (SELECT count(*) FROM base_documents WHERE lang = 'de') AS total
  FROM base_documents WHERE lang = 'de' ORDER BY created_at DESC, id DESC LIMIT 15"""
)
def query_page(t: Tables) -> DataFrame:
    return filters.query_page(t.documents(), {"attributes": {"lang": "de"}}).drop("attributes")


@query(PRELUDE + "SELECT count(*) AS total FROM base_documents WHERE doc_type = 'faq' AND id % 3 = 1")
def count_documents(t: Tables) -> DataFrame:
    return filters.count_documents(t.documents(), {"doc_type": "faq", "attributes": {"status": "draft"}})


@query(PRELUDE + "SELECT id FROM base_documents WHERE extraction_status = 'done' AND extraction_model IS DISTINCT FROM 'model-a'")
def reextract_candidates(t: Tables) -> DataFrame:
    return filters.reextract_candidates(t.documents(), status="done", not_model="model-a")


@query(PRELUDE + "SELECT id, source_path FROM base_documents WHERE source_kind = 'url'")
def refresh_candidates(t: Tables) -> DataFrame:
    return filters.refresh_candidates(t.documents())


_KNOWN = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"


@query(
    f"""SELECT o_orderkey, true AS known FROM orders WHERE o_custkey IN ({_KNOWN})
  UNION ALL SELECT o_orderkey, false FROM orders WHERE o_custkey NOT IN ({_KNOWN})"""
)
def whitelist(t: Tables) -> DataFrame:
    users = t.raw("customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("telegram_id"))
    rows = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("telegram_id"))
    return filters.whitelist(rows, users).select("o_orderkey", F.lit(True).alias("known")).unionByName(
        filters.strangers(rows, users).select("o_orderkey", F.lit(False).alias("known"))
    )


@query(PRELUDE + f"SELECT id FROM base_sessions WHERE active AND last_active_at < {AS_OF} - INTERVAL 60 MINUTE")
def idle_active_sessions(t: Tables) -> DataFrame:
    return filters.idle(t.sessions(), F.lit(MOMENT).cast("timestamp")).select("id")


# --- chunking -------------------------------------------------------------------------

_CHUNKS = rf"""
, st AS (
  SELECT id AS doc_id, doc_type, raw_content AS text, string_split(raw_content, chr(10)) AS lines, lang, source FROM base_documents
), sections AS (
  SELECT doc_id, doc_type, i, len(lines) AS n,
    (CASE WHEN doc_type = 'regulation' AND i = 1 THEN '# ' WHEN doc_type = 'regulation' THEN '## ' WHEN doc_type = 'faq' THEN '### ' ELSE '' END)
      || lines[i] AS block
  FROM st, unnest(range(1, len(lines) + 1)) r(i) WHERE NOT (doc_type = 'meeting_notes' AND doc_id % 10 = 4)
), cleaned AS (
  SELECT doc_id, doc_type, n, trim(block) AS block,
    CASE WHEN doc_type IN ('regulation', 'faq') AND n > 1 THEN i ELSE 0 END AS grp, i
  FROM sections WHERE trim(block) <> ''
), whole AS (
  SELECT doc_id, grp, 0 AS k, block AS content FROM cleaned WHERE doc_type = 'faq'
), words AS (
  SELECT doc_id, grp, i, unnest(list) AS w, generate_subscripts(list, 1) AS x
  FROM (SELECT doc_id, grp, i, string_split_regex(block, '\s+') AS list FROM cleaned WHERE length(block) > 1500 AND doc_type <> 'faq')
), ends AS (
  SELECT *, sum(length(w) + 1) OVER (PARTITION BY doc_id, i ORDER BY x) AS e, count(*) OVER (PARTITION BY doc_id, i) AS n FROM words
), jumps AS (
  SELECT a.doc_id, a.grp, a.i, a.x, a.n, greatest(coalesce(b.x, a.n + 1), a.x + 1) AS y
  FROM ends a ASOF LEFT JOIN ends b ON a.doc_id = b.doc_id AND a.i = b.i AND a.e - length(a.w) + 1500 < b.e
), cuts AS (
  SELECT doc_id, grp, i, 0 AS p, CAST(1 AS BIGINT) AS a, y AS b FROM jumps WHERE x = 1
  UNION ALL SELECT c.doc_id, c.grp, c.i, c.p + 1, c.b, j.y FROM cuts c JOIN jumps j ON j.doc_id = c.doc_id AND j.i = c.i AND j.x = c.b
), parts AS (
  SELECT doc_id, grp, i, 0 AS p, block AS unit FROM cleaned WHERE length(block) <= 1500 AND doc_type <> 'faq'
  UNION ALL SELECT c.doc_id, c.grp, c.i, c.p, string_agg(e.w, ' ' ORDER BY e.x)
  FROM cuts c JOIN ends e ON e.doc_id = c.doc_id AND e.i = c.i AND e.x >= c.a AND e.x < c.b GROUP BY ALL
), units AS (
  SELECT doc_id, grp, unit, row_number() OVER (PARTITION BY doc_id, grp ORDER BY i, p) AS u FROM parts
), packed AS (
  SELECT doc_id, grp, u, 0 AS k, [unit] AS cur, length(unit) AS used FROM units WHERE u = 1
  UNION ALL
  SELECT doc_id, grp, u, CASE WHEN spilled THEN k + 1 ELSE k END,
    CASE WHEN spilled THEN list_append(cur[len(cur) - m + 1:], unit) ELSE list_append(cur, unit) END,
    CASE WHEN spilled THEN coalesce(list_sum(list_transform(cur[len(cur) - m + 1:], lambda v: length(v) + 2)), 0) + length(unit) + 2
      ELSE used + 2 + length(unit) END
  FROM (SELECT n.doc_id, n.grp, n.u, p.k, p.cur, p.used, n.unit, p.used + 2 + length(n.unit) > 1500 AS spilled,
      list_max(list_filter(range(0, len(p.cur) + 1), lambda m: coalesce(list_sum(list_transform(
        p.cur[len(p.cur) - m + 1:], lambda v: length(v) + 2)), 0) - 2 <= 200)) AS m
    FROM packed p JOIN units n ON n.doc_id = p.doc_id AND n.grp = p.grp AND n.u = p.u + 1)
), notes AS (
  SELECT doc_id, i, '- ' || lines[i] AS line, 'Дата: 2024-05-12; Участники: ' || lang || ', ' || source AS head
  FROM st, unnest(range(1, len(lines) + 1)) r(i) WHERE doc_type = 'meeting_notes' AND doc_id % 10 = 4
), noted AS (
  SELECT doc_id, i, 0 AS k, line, head, length(head) + 8 + 7 + length(line) + 1 AS used FROM notes WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN p.used + length(n.line) + 1 > 1500 THEN p.k + 1 ELSE p.k END, n.line, n.head,
    CASE WHEN p.used + length(n.line) + 1 > 1500 THEN length(n.head) + 8 + 7 ELSE p.used END + length(n.line) + 1
  FROM noted p JOIN notes n ON n.doc_id = p.doc_id AND n.i = p.i + 1
), all_chunks AS (
  SELECT doc_id, grp, k, content FROM whole
  UNION ALL SELECT doc_id, grp, k, array_to_string(arg_max(cur, u), chr(10) || chr(10)) FROM packed GROUP BY doc_id, grp, k
  UNION ALL SELECT doc_id, 0, k, any_value(head) || chr(10) || chr(10) || 'Решения:' || chr(10) || string_agg(line, chr(10) ORDER BY i)
  FROM noted GROUP BY doc_id, k
)
SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, k) - 1 AS INTEGER) AS chunk_index,
  length(content) AS chars, md5(content) AS content FROM all_chunks
"""


@query(PRELUDE + _CHUNKS)
def chunk_by_type(t: Tables) -> DataFrame:
    chunks = chunk_documents(t.structured_documents())
    return chunks.select("document_id", "chunk_index", F.length("content").alias("chars"), F.md5("content").alias("content"))


@query(PRELUDE + "SELECT document_id, chunk_index, content FROM base_chunks")
def chunk_plain_text(t: Tables) -> DataFrame:
    return t.chunks().select("document_id", "chunk_index", "content")


# --- files ------------------------------------------------------------------------------------


@query("SELECT doc_id, 'file' AS source_kind, sha256(coalesce(text, '') || chr(10)) AS content_hash FROM documents")
def text_files(t: Tables) -> DataFrame:
    """Every document as a text file of its own, read back; a written line ends with a line feed."""
    named = t.raw("documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), "text")
    folders = R.write_files(named, fresh_path(t.spark, "files"))
    doc_id = F.regexp_extract("source_path", r"/([0-9]+)\.txt$", 1).cast("bigint")
    return R.read_text_documents(t.spark, folders).select(doc_id.alias("doc_id"), "source_kind", F.sha2("text", 256).alias("content_hash"))


@query(
    """SELECT CAST(item_id AS INTEGER) AS n, 'part ' || (item_id % 9) AS section, text AS question,
  CASE WHEN item_id % 3 > 0 THEN 'answer ' || item_id END AS expected, item_id % 6 = 0 AS out_of_corpus FROM benchmark"""
)
def question_files(t: Tables) -> DataFrame:
    """Benchmark questions in JSON files, read back; a missing answer stays missing."""
    n = F.col("item_id")
    row = F.struct(
        n.alias("n"), F.concat(F.lit("part "), n % 9).alias("section"), F.col("text").alias("question"),
        F.when(n % 3 > 0, F.concat(F.lit("answer "), n)).alias("expected"), (n % 6 == 0).alias("out_of_corpus"),
    )
    named = t.raw("benchmark").select(F.concat(n, F.lit(".json")).alias("name"), F.to_json(row).alias("text"))
    return R.read_questions(t.spark, R.write_files(named, fresh_path(t.spark, "questions")))


@query(
    """SELECT title, doc_type, required FROM (SELECT 'DOC ' || doc_id AS title,
  CASE WHEN toxic = 1 THEN 'faq' ELSE 'generic' END AS doc_type, CASE WHEN quality = 1 THEN ['owner', 'status'] ELSE [] END AS required FROM labels)"""
)
def labelled_files(t: Tables) -> DataFrame:
    """Labelled sets in JSON files, read back: one set for each label, without required attributes for some."""
    n = F.col("doc_id")
    required = F.when(F.col("quality") == 1, F.array(F.lit("owner"), F.lit("status")))
    label = F.struct(F.when(F.col("toxic") == 1, "faq").otherwise("generic").alias("doc_type"), required.alias("required"))
    made = F.struct(F.create_map(F.concat(F.lit("DOC "), n), label).alias("documents"))
    named = t.raw("labels").select(F.concat(n, F.lit(".json")).alias("name"), F.to_json(made).alias("text"))
    return R.read_labelled_set(t.spark, R.write_files(named, fresh_path(t.spark, "labelled")))[0]
