"""Entity look-up, mentions, walks, cards and name resolution."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.operators import graph as G
from lorehouse.operators import links as K
from lorehouse.operators.versions import orphans as find_orphans
from lorehouse.plans.catalog import query
from lorehouse.plans.prelude import PRELUDE
from lorehouse.plans.views import Tables


@query(
    PRELUDE + """SELECT m.entity_id, d.id, d.title, d.doc_type, m.role FROM base_mentions m
  JOIN base_documents d ON d.id = m.document_id WHERE m.invalid_at IS NULL"""
)
def documents_of_entities(t: Tables) -> DataFrame:
    return G.documents_of_entities(t.mentions(), t.documents())


@query(
    PRELUDE + """SELECT m.document_id, m.entity_id, e.entity_type, e.name, m.role FROM base_mentions m
  JOIN base_entities e ON e.id = m.entity_id WHERE m.invalid_at IS NULL"""
)
def entities_of_documents(t: Tables) -> DataFrame:
    return G.entities_of_documents(t.mentions(), t.entities())


@query(
    PRELUDE + """SELECT c.chunk_id, d.title FROM base_chunks c JOIN base_documents d ON d.id = c.document_id
  WHERE d.doc_type = 'faq'"""
)
def chunk_titles(t: Tables) -> DataFrame:
    titles = t.documents().filter("doc_type = 'faq'").select(F.col("id").alias("document_id"), "title")
    return t.chunks().select("chunk_id", "document_id").join(titles, "document_id").select("chunk_id", "title")


@query(
    PRELUDE + """SELECT id, NOT EXISTS (SELECT 1 FROM base_links s WHERE s.kind = 'supersedes' AND s.target_id = d.id
    AND s.invalid_at IS NULL) AS current FROM base_documents d"""
)
def current_flags(t: Tables) -> DataFrame:
    return G.with_current(t.documents().select("id"), t.links())


@query(
    PRELUDE + """SELECT e.id, e.name FROM base_entities e WHERE NOT EXISTS (SELECT 1 FROM base_mentions m WHERE m.entity_id = e.id)
  AND e.id NOT IN (SELECT source_id FROM base_relations WHERE relation = 'related_to')
  AND e.id NOT IN (SELECT target_id FROM base_relations WHERE relation = 'related_to')"""
)
def orphans(t: Tables) -> DataFrame:
    sold = t.relations().filter("relation = 'related_to'")
    return find_orphans(t.entities(), t.mentions(), sold).select("id", "name")


_WALK = """
, both_base AS (SELECT source_id AS v, target_id AS w FROM base_relations WHERE invalid_at IS NULL
  UNION SELECT target_id, source_id FROM base_relations WHERE invalid_at IS NULL),
one AS (SELECT e.id AS root, w AS id FROM base_entities e JOIN both_base ON v = e.id),
two AS (SELECT DISTINCT root, w AS id FROM one JOIN both_base ON v = id),
reached AS (SELECT root, id, min(depth) AS depth FROM (
  SELECT id AS root, id, 0 AS depth FROM base_entities UNION ALL SELECT root, id, 1 FROM one UNION ALL SELECT root, id, 2 FROM two) GROUP BY 1, 2),
nodes AS (SELECT root, id, depth FROM reached QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, id) <= 40)
"""


def _roots(t: Tables) -> DataFrame:
    return t.entities().select(F.col("id").alias("root"))


@query(PRELUDE + _WALK + "SELECT n.root, n.id, e.entity_type AS type, e.name, n.depth FROM nodes n JOIN base_entities e ON e.id = n.id")
def neighbor_nodes(t: Tables) -> DataFrame:
    return G.neighbors(_roots(t), t.entities(), t.relations(), 2)[0]


@query(
    PRELUDE + _WALK + """SELECT a.root, r.source_id AS source, r.target_id AS target, r.relation, count(*) AS n FROM nodes a
  JOIN base_relations r ON r.source_id = a.id AND r.invalid_at IS NULL JOIN nodes b ON b.root = a.root AND b.id = r.target_id GROUP BY ALL"""
)
def neighbor_edges(t: Tables) -> DataFrame:
    edges = G.neighbors(_roots(t), t.entities(), t.relations(), 2)[1]
    return edges.groupBy("root", "source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


_RELATED = """
, pair_base AS (SELECT source_id AS v, target_id AS w FROM base_links WHERE invalid_at IS NULL
  UNION SELECT target_id, source_id FROM base_links WHERE invalid_at IS NULL),
hop AS (
  SELECT id AS root, id, 0 AS depth FROM base_documents
  UNION SELECT h.root, p.w, h.depth + 1 FROM hop h JOIN pair_base p ON p.v = h.id WHERE h.depth < 3),
near AS (SELECT root, id, min(depth) AS depth FROM hop GROUP BY 1, 2)
SELECT root, d.id, d.title, d.doc_type, d.version, depth, NOT EXISTS (SELECT 1 FROM base_links s
  WHERE s.kind = 'supersedes' AND s.target_id = d.id AND s.invalid_at IS NULL) AS current
FROM near JOIN base_documents d ON d.id = near.id WHERE root <> near.id
"""


@query(PRELUDE + _RELATED)
def related_documents(t: Tables) -> DataFrame:
    roots = t.documents().select(F.col("id").alias("root"))
    return G.related_documents(roots, t.documents(), t.links(), 3)


_NAMES = """names AS (
  SELECT upper(name) || ' ' AS name FROM base_entities WHERE entity_type IN ('project', 'person')
  UNION SELECT right(name, 5) FROM base_entities WHERE entity_type = 'product'
  UNION SELECT left(name, 2) FROM base_entities UNION SELECT 'R#00' || c_mktsegment FROM customer)"""


@query(
    PRELUDE + f""", {_NAMES}, found AS (SELECT name, coalesce(
    (SELECT min(id) FROM base_entities e WHERE e.canonical = lower(trim(n.name))),
    (SELECT min(id) FROM base_entities e WHERE contains(lower(e.name), lower(n.name)))) AS entity_id FROM names n)
  SELECT * FROM found WHERE entity_id IS NOT NULL"""
)
def find_entities(t: Tables) -> DataFrame:
    e = t.entities()
    names = (
        e.filter(F.col("entity_type").isin("project", "person")).select(F.concat(F.upper("name"), F.lit(" ")).alias("name"))
        .union(e.filter("entity_type = 'product'").select(F.right("name", F.lit(5))))
        .union(e.select(F.left("name", F.lit(2))))
        .union(t.raw("customer").select(F.concat(F.lit("R#00"), "c_mktsegment")))
    )
    return G.find_entities(names, e)


def _supplier_names(t: Tables) -> DataFrame:
    return t.raw("supplier").select(F.lower("s_name").alias("name")).unionByName(
        t.raw("region").select(F.concat(F.lit("no "), "r_name").alias("name"))
    )


@query(
    PRELUDE + """SELECT lower(s_name) AS name, s_suppkey * 8 + 3 AS entity_id, 'person' AS entity_type, s_name AS entity_name FROM supplier
  UNION ALL SELECT 'no ' || r_name, NULL, NULL, NULL FROM region"""
)
def entity_cards(t: Tables) -> DataFrame:
    cards = G.entity_cards(_supplier_names(t), t.entities(), t.mentions(), t.documents(), t.relations(), parts=["entity"])
    return cards["entity"].drop("attributes")


@query(
    PRELUDE + """SELECT lower(s_name) AS name, d.id, d.title, d.doc_type, m.role FROM supplier
  JOIN base_mentions m ON m.entity_id = s_suppkey * 8 + 3 AND m.invalid_at IS NULL JOIN base_documents d ON d.id = m.document_id"""
)
def entity_card_documents(t: Tables) -> DataFrame:
    cards = G.entity_cards(_supplier_names(t), t.entities(), t.mentions(), t.documents(), t.relations(), parts=["documents"])
    return cards["documents"]


@query(
    PRELUDE + """SELECT d.id, d.title, d.version, (SELECT count(*) FROM base_chunks c WHERE c.document_id = d.id) AS chunks,
    (SELECT count(*) FROM base_mentions m WHERE m.document_id = d.id AND m.invalid_at IS NULL) AS entities,
    (SELECT count(DISTINCT x) FROM (SELECT target_id AS x FROM base_links l WHERE l.source_id = d.id AND l.invalid_at IS NULL
      UNION ALL SELECT source_id FROM base_links l WHERE l.target_id = d.id AND l.invalid_at IS NULL)) AS related
  FROM base_documents d"""
)
def document_cards(t: Tables) -> DataFrame:
    d = t.documents()
    cards = G.document_cards(d.select("id"), d, t.chunks(), t.entities(), t.mentions(), t.links())
    entities = cards["entities"].groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("entities"))
    related = cards["related"].groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("related"))
    return (
        cards["document"].join(entities, "id", "left").join(related, "id", "left")
        .select("id", "title", "version", "chunks", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("related", F.lit(0)).alias("related"))
    )


# --- names to ids -------------------------------------------------------------------------

_MATCHED = """, matched AS (SELECT DISTINCT n.source_id, n.name,
  (SELECT min(d.id) FROM base_documents d WHERE d.source_path = n.name OR lower(d.title) = lower(n.name)) AS target_id FROM base_link_names n)"""


@query(PRELUDE + _MATCHED + "SELECT DISTINCT source_id, target_id FROM matched WHERE target_id <> source_id")
def resolve_links(t: Tables) -> DataFrame:
    return K.resolve_links(t.link_names(), t.documents())[0]


@query(PRELUDE + _MATCHED + "SELECT source_id, name AS target_name FROM matched WHERE target_id IS NULL")
def unresolved_links(t: Tables) -> DataFrame:
    return K.resolve_links(t.link_names(), t.documents())[1]


@query(
    PRELUDE + """, m AS (SELECT p.*, (SELECT min(d.id) FROM base_documents d WHERE d.doc_type <> 'faq' AND
    (d.source_path = p.target_name OR lower(d.title) = lower(p.target_name))) AS target_id FROM base_pending p)
  SELECT source_id, target_id, kind, NULL AS target_name FROM m WHERE target_id <> source_id
  UNION ALL SELECT source_id, NULL, kind, target_name FROM m WHERE target_id IS NULL"""
)
def resolve_pending(t: Tables) -> DataFrame:
    created, rest = K.resolve_pending(t.pending_links(), t.documents().filter("doc_type <> 'faq'"))
    return created.withColumn("target_name", F.lit(None).cast("string")).unionByName(
        rest.withColumn("target_id", F.lit(None).cast("bigint"))
    )
