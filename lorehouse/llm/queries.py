"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorehouse.llm import byte_pairs, collocations, decontamination, fingerprints, main_text, merkle, near_duplicates, packing, sharding, suffix_dedup, tokens, toxicity, warc
from lorehouse.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, learned from the labels that may be learned from."""
    return toxicity.toxicity_digest(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids in flat files, read back."""
    return tokens.token_digest(_table(spark, folder, "documents"))


def op3_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"))


def op4_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_digest(_table(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return main_text.extract_main_text(_table(spark, folder, "pages"))


def op6_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of all pages, written as WARC files and read back."""
    return warc.derivative_digest(_table(spark, folder, "pages"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the passages of 50 bytes that an earlier one has."""
    return suffix_dedup.repeat_digest(_table(spark, folder, "documents"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return near_duplicates.class_digest(_table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    return decontamination.leak_digest(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_shard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard_digest(_table(spark, folder, "documents"), 40)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of all documents that keep together best, per language."""
    return collocations.phrase_digest(_table(spark, folder, "documents"))


def op12_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as byte-pair ids and back."""
    return byte_pairs.coding_digest(_table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in one hash tree per language, with proofs and the outcome of tampering."""
    return merkle.manifest_digest(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    """The operators' queries and the pipeline."""
    found = (
        op1_toxicity,
        op2_token_files,
        op3_pack,
        op4_fingerprint,
        op5_main_text,
        op6_warc_derivatives,
        op7_suffix_dedup,
        op8_near_duplicates,
        op9_decontaminate,
        op10_shard,
        op11_collocations,
        op12_byte_pairs,
        op13_merkle,
        pipeline,
    )
    return {q.__name__: q for q in found}


_MERKLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
    xor(list_reduce([4294967295::BIGINT] || [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda r, b: list_reduce([xor(r, b)] || [0::BIGINT FOR k IN range(8)],
        lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 3 = 0 AS chosen
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN chosen THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS changed
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER () AS nth, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), up AS (
  SELECT lang, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE n > 1
  GROUP BY lang, level, place // 8, n
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), above AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM above WHERE n > 1
  GROUP BY level, place // 8, n
), runs AS (
  SELECT coalesce('=' || lang, '-') AS tree, level, place // 8 AS run, list(h ORDER BY place) AS hs FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 'top', level, place // 8, list(h ORDER BY place) FROM above WHERE n > 1 GROUP BY ALL
), path AS (
  SELECT l.nth, 0 AS step, coalesce('=' || l.lang, '-') AS tree, 0 AS level, l.place, s.place AS top_place,
    coalesce(l.changed, l.leaf) AS node, '' AS proof, false AS done
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT p.nth, p.step + 1, CASE WHEN r.hs IS NULL THEN 'top' ELSE p.tree END, CASE WHEN r.hs IS NULL THEN 0 ELSE p.level + 1 END,
    CASE WHEN r.hs IS NULL THEN p.top_place ELSE p.place // 8 END, p.top_place,
    CASE WHEN r.hs IS NULL THEN p.node ELSE sha256(array_to_string(r.hs[1:p.place % 8], '') || p.node || array_to_string(r.hs[p.place % 8 + 2:], '')) END,
    p.proof || coalesce(array_to_string(r.hs[1:p.place % 8], '') || array_to_string(r.hs[p.place % 8 + 2:], ''), ''),
    r.hs IS NULL AND p.tree = 'top'
  FROM path p LEFT JOIN runs r ON r.tree = p.tree AND r.level = p.level AND r.run = p.place // 8
  WHERE NOT p.done
)
SELECT l.doc_id, l.leaf, s.subroot, a.h AS root, sha256(p.proof) AS proof_sha256, p.node AS folded_root, p.node = a.h AS verified,
  l.lang, l.place AS leaf_place
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN path p ON p.nth = l.nth AND p.done JOIN above a ON a.n = 1
"""

_COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, doc, generate_subscripts(parts, 1) AS piece, unnest(parts) AS piece_text FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
    FROM documents)
), words AS (
  SELECT lang, doc, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
    SELECT lang, doc, piece, list_filter(string_split_regex(piece_text, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)
), threes AS (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc, piece ORDER BY i)
), f AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM threes GROUP BY ALL
  UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, count(*) FROM threes WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM threes WHERE w3 IS NOT NULL GROUP BY ALL
), cand AS (
  SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE words >= 2 AND f >= 10
), cuts AS (
  SELECT c.*, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cand c JOIN (SELECT unnest([1, 2]) AS k) k ON k.k < c.words
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k.k + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(ws[k:k + 1], ' ') AS phrase, max(a) AS f FROM cand, (SELECT unnest([1, 2]) AS k) WHERE words = 3 GROUP BY ALL
), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase AND c.words = 2
  WHERE g.f IS NULL OR 100 * g.f < 50 * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one: tokens, keyed hashes and kernels have none, so tests/llm holds brute-force versions."""
    return {"op11_collocations": _COLLOCATIONS_SQL, "op13_merkle": _MERKLE_SQL}
