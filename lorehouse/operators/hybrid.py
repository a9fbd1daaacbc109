"""Hybrid search: vector and full-text candidates fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse import fixed_values as fixed
from lorehouse.functions.embedding import embed
from lorehouse.operators.block_postings import top_k_by_blocks
from lorehouse.operators.cell_index import CellIndex, search_cells
from lorehouse.operators.lexical import Analyzer, lexical_top_k
from lorehouse.operators.vector_search import cosine_top_k
from lorehouse.session import cut_lineage


def reciprocal_rank_fusion(ranked: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Fuse ``(query_id, list, item_id, rank)`` rows into ``(query_id, item_id, score, first)``.

    ``list`` numbers the ranked lists; ``first`` is the first place an item
    appears in, which settles equal scores.
    """
    return ranked.groupBy("query_id", "item_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min(F.struct("list", "rank")).alias("first"),
    )


def rank_in_list(scored: DataFrame, score: str = "score", tie: str = "item_id") -> DataFrame:
    """1-based rank of the candidates of each list."""
    order = Window.partitionBy("query_id", "list").orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order))


def fused_top(
    vector: DataFrame, lexical: DataFrame, limit: int = fixed.SEARCH_LIMIT
) -> DataFrame:
    """Best ``limit`` chunks of each query from two ranked candidate lists."""
    lists = vector.select(
        "query_id", F.lit(0).alias("list"), F.col("item_id"), "rank"
    ).unionByName(
        lexical.select("query_id", F.lit(1).alias("list"), F.col("chunk_id").alias("item_id"), "rank")
    )
    fused = reciprocal_rank_fusion(lists)
    # equal ranks in two lists give equal sums; rounding hides the order of addition
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first")
    return (
        fused.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("query_id", F.col("item_id").alias("chunk_id"), F.round("score", 6).alias("score"), "place")
    )


def search_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    *,
    within: DataFrame | None = None,
    limit: int = fixed.SEARCH_LIMIT,
    candidates: int = fixed.CANDIDATES_PER_LIST,
    dim: int = fixed.EMBED_DIM,
    analyzer: Analyzer | None = None,
    vectors: CellIndex | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Answer a table of questions: document_id, document, score, fragment per place.

    With the stored indexes of the same chunks, ``vectors`` (approximate) and
    ``blocks`` (exact), neither search reads all chunks.

    ``queries``: query_id, query. ``chunks``: chunk_id, document_id, content,
    embedding and tokens, as stored. ``documents``: id, title. ``within``:
    filtered documents; both lists then only see chunks of these, before any
    ranking. Without it no join touches the chunk table but for the few results.
    """
    inside = chunks
    if within is not None:
        ids = within.select(F.col("id").alias("document_id"))
        inside = chunks.join(ids, "document_id", "left_semi")
    asked = embed(queries, "query", is_query=True, dim=dim)
    items = F.col("chunk_id").alias("item_id")
    if vectors is None:
        vector = cosine_top_k(asked, inside.select(items, "embedding"), candidates)
    else:
        filtered = None if within is None else inside.select(items)
        vector = search_cells(asked, vectors, chunks.select(items, "embedding"), candidates, within=filtered)
    if blocks is None:
        lexical = lexical_top_k(queries, inside.select("chunk_id", "tokens"), candidates, analyzer)
    else:
        filtered = None if within is None else inside.select("chunk_id")
        lexical = top_k_by_blocks(queries, blocks, chunks.select("chunk_id", "tokens"), candidates, analyzer, filtered)[0]
    # a few rows per query: with their true size they are broadcast to the large tables
    best = cut_lineage(fused_top(vector, lexical, limit), "best")
    fragments = chunks.select("chunk_id", "document_id", F.col("content").alias("fragment"))
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document"))
    return (
        best.join(fragments, "chunk_id")
        .join(titles, "document_id")
        .select("query_id", "place", "document_id", "document", "score", "fragment")
    )
