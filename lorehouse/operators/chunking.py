"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.chunks import chunk_text


def chunk_documents(
    documents: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """``(document_id, chunk_index, content)`` rows of ``(id, raw_content, doc_type, attributes)``.

    A narrow transformation: no shuffle and no Python worker.
    """
    chunks = chunk_text(
        F.col("raw_content"), F.col("doc_type"), F.col("attributes"), size, overlap
    )
    # the outer form keeps the optimizer from adding a filter that evaluates the array again
    return documents.select(
        F.col("id").alias("document_id"), F.posexplode_outer(chunks).alias("chunk_index", "content")
    ).filter(F.col("content").isNotNull())
