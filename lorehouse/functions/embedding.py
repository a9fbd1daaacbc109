"""Embeddings: a pluggable batch model and the hashing bag-of-words default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import terms

VECTOR = T.ArrayType(T.FloatType())

# A model factory is called once per task and returns texts -> matrix (one row per text).
Model = Callable[[list[str]], np.ndarray]


def query_text(query: Column) -> Column:
    """Text embedded for a query; documents are embedded as they are."""
    return F.concat(F.lit(fixed.QUERY_PREFIX), query)


def to_list_array(matrix: np.ndarray) -> pa.Array:
    """Arrow list column with one fixed-length row per matrix row."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def to_matrix(column: pa.Array, dtype: type = np.float32) -> np.ndarray:
    """Matrix of an Arrow list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def token_buckets(tokens: pa.Array, dim: int = fixed.EMBED_DIM) -> np.ndarray:
    """Hash bucket of every token, from the first 32 bits of its MD5; the same in every process and engine.

    Each word is hashed once per batch, however often it occurs.
    """
    words = tokens.dictionary_encode()
    digests = [hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4] for w in words.dictionary.to_pylist()]
    buckets = np.frombuffer(b"".join(digests), ">u4").astype(np.int64) % dim
    return buckets[words.indices.to_numpy(zero_copy_only=False)]


def hashing_vector(tokens: Column, dim: int = fixed.EMBED_DIM) -> Column:
    """Unit vector of token counts per bucket; tokenized in the JVM, counted per Arrow batch."""

    @F.arrow_udf(VECTOR)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(batch)), lengths)
            cells = token_buckets(batch.flatten(), dim)
            counts = np.bincount(rows * dim + cells, minlength=len(batch) * dim)
            yield to_list_array(unit_rows(counts.reshape(len(batch), dim).astype(np.float64)))

    return count(tokens)


def model_vector(text: Column, factory: Callable[[], Model], batch: int = 32) -> Column:
    """Vectors of a custom model, loaded once per task and called on small batches."""

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.list_(pa.float32()))
                continue
            parts = [
                np.asarray(model(texts.slice(start, batch).to_pylist()))
                for start in range(0, len(texts), batch)
            ]
            yield to_list_array(np.vstack(parts))

    return run(text)


def embed(
    rows: DataFrame,
    text: str,
    out: str = "embedding",
    *,
    is_query: bool = False,
    dim: int = fixed.EMBED_DIM,
    factory: Callable[[], Model] | None = None,
    batch: int = 32,
    tokens: str | None = None,
) -> DataFrame:
    """Add an embedding column; queries get the retrieval prefix.

    ``tokens``: column that already holds the words of the text, so that the default does not split it again.
    """
    source = query_text(F.col(text)) if is_query else F.col(text)
    vector = model_vector(source, factory, batch) if factory else hashing_vector(F.col(tokens) if tokens else terms(source), dim)
    return rows.withColumn(out, vector)


def truncate_and_renormalize(vector: Column, dim: int) -> Column:
    """Leading ``dim`` components scaled to length one; a zero vector stays zero."""
    head = F.slice(vector, 1, dim)
    square = F.aggregate(
        head, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.transform(
        F.array(F.sqrt(square)),
        lambda norm: F.when(norm == 0, head).otherwise(
            F.transform(head, lambda x: (x.cast("double") / norm).cast("float"))
        ),
    )[0]
