"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lorehouse.plans.catalog import queries  # noqa: E402
from lorehouse.session import build_session  # noqa: E402

HEADLINE = (
    "chunk_by_type",
    "chunk_plain_text",
    "extract_pages",
    "embed_chunks",
    "cosine_top_k",
    "cosine_top_k_by_cells",
    "approximate_top_k",
    "lexical_index",
    "lexical_top_k",
    "hybrid_search",
    "query_documents",
    "filter_entity",
    "corpus_stats",
    "degree_top_k",
    "cost_by_user",
    "usage_totals",
    "trace_facts",
    "fact_history",
    "normalize_extractions",
    "plan_ingest",
    "fold_versions",
    "replace_mentions",
    "replace_relations",
    "replace_links",
    "upsert_facts",
    "neighbor_nodes",
    "neighbor_edges",
    "related_documents",
    "find_entities",
    "toggle_sessions",
    "idle_sessions_stream",
    "conversation_segments_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    # start the JVM code paths and Python workers before the clock
    registered["topic_slugs"](spark, folder).write.format("noop").mode("overwrite").save()
    registered["embed_queries"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
