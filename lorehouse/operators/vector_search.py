"""Exact and approximate nearest neighbours by cosine.

Queries that fit a measured bound are broadcast, and the corpus is scanned once
without a shuffle. A larger query table is cut into cells of bounded size that
meet corpus cells of bounded size in cogroups. Both keep only the best ``k`` per
query and task, and give the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorehouse.functions.embedding import to_matrix, unit_rows

BROADCAST_BYTES = 32 * 1024 * 1024
CELL_BYTES = 16 * 1024 * 1024
PAIRS_AT_ONCE = 4_000_000
MAX_KEYS = 1 << 20
SCORE_DIGITS = 9


def _exact_scores(queries: np.ndarray, items: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Double-precision scores of index pairs, in slices of bounded memory."""
    step = max(1, PAIRS_AT_ONCE // max(queries.shape[1], 1))
    parts = [
        np.einsum("ij,ij->i", queries[q[i : i + step]], items[c[i : i + step]])
        for i in range(0, len(q), step)
    ]
    return np.concatenate(parts).round(SCORE_DIGITS) if parts else np.zeros(0)


def best_pairs(
    query_ids: np.ndarray,
    queries: np.ndarray,
    item_ids: np.ndarray,
    items: np.ndarray,
    k: int,
    above: float | None = None,
) -> pd.DataFrame:
    """Best ``k`` items of every query within one block, by unit vectors.

    Single precision finds the candidates with a margin wider than its error;
    the survivors are scored again in double precision. Queries are taken in
    slices, so a block full of equal vectors needs no more memory than others.
    """
    found = [pd.DataFrame({"query_id": query_ids[:0], "item_id": item_ids[:0], "score": np.zeros(0)})]
    step = max(1, PAIRS_AT_ONCE // max(len(item_ids), 1)) if len(item_ids) else 1
    single = items.astype(np.float32).T
    margin = 1e-6 * (items.shape[1] + 16) if len(item_ids) else 0.0
    for start in range(0, len(query_ids) if len(item_ids) else 0, step):
        ids, vectors = query_ids[start : start + step], queries[start : start + step]
        rough = vectors.astype(np.float32) @ single
        if len(item_ids) > k:
            kth = np.partition(rough, len(item_ids) - k, axis=1)[:, len(item_ids) - k]
            floor = kth - 2 * margin
        else:
            floor = np.full(len(ids), -np.inf)
        if above is not None:
            floor = np.maximum(floor, above - margin)
        q, c = np.nonzero(rough >= floor[:, None])
        block = pd.DataFrame(
            {"query_id": ids[q], "item_id": item_ids[c], "score": _exact_scores(vectors, items, q, c)}
        )
        if above is not None:
            block = block[block["score"] > above]
        found.append(_first_k(block, k))
    return pd.concat(found)


def _first_k(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = pairs.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _arrow_pairs(query_type: pa.DataType, item_type: pa.DataType) -> pa.Schema:
    return pa.schema([("query_id", query_type), ("item_id", item_type), ("score", pa.float64())])


def _unit(column: pa.Array) -> np.ndarray:
    return unit_rows(to_matrix(column, np.float64))


def _pair_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _by_broadcast(
    queries: DataFrame, items: DataFrame, k: int, above: float | None
) -> DataFrame:
    schema = _pair_schema(queries, items)
    table = queries.toArrow().combine_chunks()
    ids = _ids(table.column("query_id").combine_chunks())
    matrix = _unit(table.column("embedding").combine_chunks())
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
    query_type = table.schema.field("query_id").type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        best, item_type = None, None
        for batch in batches:
            item_type = batch.schema.field("item_id").type
            block = best_pairs(
                query_ids, query_matrix, _ids(batch.column("item_id")),
                _unit(batch.column("embedding")), k, above,
            )
            best = block if best is None else _first_k(pd.concat([best, block]), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(
                best, schema=_arrow_pairs(query_type, item_type), preserve_index=False
            )

    return items.select("item_id", "embedding").mapInArrow(scan, schema)


def _cells(rows: DataFrame, id_column: str, keys: list[str], rows_per_cell: int) -> DataFrame:
    """Add ``_cell`` and ``_cells``: rows of one key spread over cells of bounded size."""
    sizes = rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / rows_per_cell).alias("_cells")
    )
    # one row per key, and callers bound the number of keys (MAX_KEYS)
    return rows.join(F.broadcast(sizes), keys).withColumn(
        "_cell", F.pmod(F.xxhash64(id_column), F.col("_cells"))
    )


def _numbers(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def _by_cells(
    queries: DataFrame, items: DataFrame, keys: list[str], dim: int, k: int, above: float | None
) -> DataFrame:
    """Every query cell meets every item cell of the same key in one cogroup."""
    schema = _pair_schema(queries, items)
    per_cell = max(1, CELL_BYTES // (8 * max(dim, 1)))
    left = _cells(queries, "query_id", keys, per_cell)
    right = _cells(items, "item_id", keys, per_cell)
    left_counts = left.select(*keys, F.col("_cells").alias("_q_cells")).distinct()
    right_counts = right.select(*keys, F.col("_cells").alias("_i_cells")).distinct()
    # aliases keep the two sides apart when both come from the same table
    left = left.join(F.broadcast(right_counts), keys).select(
        *[F.col(key).alias(f"_q{key}") for key in keys],
        F.col("_cell").alias("_qq"),
        _numbers("_i_cells").alias("_qi"),
        F.col("query_id").alias("query_id"),
        F.col("embedding").alias("_q_vector"),
    )
    right = right.join(F.broadcast(left_counts), keys).select(
        *[F.col(key).alias(f"_i{key}") for key in keys],
        _numbers("_q_cells").alias("_iq"),
        F.col("_cell").alias("_ii"),
        F.col("item_id").alias("item_id"),
        F.col("embedding").alias("_i_vector"),
    )

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        if one.num_rows and other.num_rows:
            found = best_pairs(
                _ids(one.column("query_id").combine_chunks()),
                _unit(one.column("_q_vector").combine_chunks()),
                _ids(other.column("item_id").combine_chunks()),
                _unit(other.column("_i_vector").combine_chunks()),
                k,
                above,
            )
        else:
            found = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        target = _arrow_pairs(
            one.schema.field("query_id").type, other.schema.field("item_id").type
        )
        return pa.Table.from_pandas(found, schema=target, preserve_index=False)

    left_cell = [*[f"_q{key}" for key in keys], "_qq", "_qi"]
    right_cell = [*[f"_i{key}" for key in keys], "_iq", "_ii"]
    return left.groupBy(*left_cell).cogroup(right.groupBy(*right_cell)).applyInArrow(meet, schema)


def _keep_best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_size(queries: DataFrame) -> tuple[int, int]:
    row = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    ).first()
    return row["n"], row["dim"]


def cosine_top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    above: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact ``(query_id, item_id, score, rank)`` of the ``k`` nearest items.

    ``queries``: query_id, embedding. ``items``: item_id, embedding, already
    filtered: the filter comes before the top-k. ``above`` keeps only strictly
    greater scores. Scores are rounded to nine digits, equal scores go by item id.
    """
    queries = queries.select("query_id", "embedding")
    items = items.select("item_id", "embedding")
    count, dim = _query_size(queries)
    if count * dim * 8 <= broadcast_bytes:
        pairs = _by_broadcast(queries, items, k, above)
    else:
        everywhere = F.lit(0).alias("_key")
        pairs = _by_cells(
            queries.select("*", everywhere), items.select("*", everywhere), ["_key"], dim, k, above
        )
    return _keep_best(pairs, k)


def _signatures(vector: Column, dim: int, bits: int, tables: int, seed: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.list_(pa.int64()))
                continue
            side = to_matrix(batch, np.float64) @ planes > 0
            codes = side.reshape(len(batch), tables, bits) @ powers
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            yield pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int64).ravel()))

    return sign(vector)


def lsh_top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    bits: int = 8,
    tables: int = 8,
    seed: int = 0,
) -> DataFrame:
    """Approximate twin of ``cosine_top_k``: only vectors sharing a hyperplane bucket meet.

    Buckets of any size are handled in bounded cells, so a hot bucket is spread
    over many tasks and never listed pair by pair.
    """
    if tables << bits > MAX_KEYS:
        raise ValueError(f"tables x buckets must not exceed {MAX_KEYS}")
    _, dim = _query_size(queries)

    def bucketed(rows: DataFrame, id_column: str) -> DataFrame:
        codes = _signatures(F.col("embedding"), dim, bits, tables, seed)
        return rows.select(
            id_column, "embedding", F.posexplode(codes).alias("_table", "_bucket")
        )

    pairs = _by_cells(
        bucketed(queries.select("query_id", "embedding"), "query_id"),
        bucketed(items.select("item_id", "embedding"), "item_id"),
        ["_table", "_bucket"],
        dim,
        k,
        None,
    )
    # the same pair may meet in several tables
    pairs = pairs.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return _keep_best(pairs, k)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that an approximate search found."""
    hits = exact.select("query_id", "item_id").join(
        found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left"
    )
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def dimension_report(rows: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Stored dimensions that differ from the configured one, with their row counts."""
    return (
        rows.groupBy(F.size(column).alias("stored_dim"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("matches", F.col("stored_dim") == dim)
    )


def require_dimension(rows: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fail the job when a vector has another dimension."""
    checked = F.when(F.size(column) == dim, F.col(column)).otherwise(
        F.raise_error(F.lit(f"embedding dimension is not {dim}")).cast(rows.schema[column].dataType)
    )
    return rows.withColumn(column, checked)
