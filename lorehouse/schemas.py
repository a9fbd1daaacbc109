"""Table schemas and the registry of document types."""

from __future__ import annotations

from pyspark.sql import types as T

from lorehouse import fixed_values as fixed

MANIFEST_ENTRY = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_kind", T.StringType()),
    ]
)

BENCHMARK_QUESTION = T.StructType(
    [
        T.StructField("n", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("out_of_corpus", T.BooleanType()),
    ]
)

LABELLED_SET = T.StructType(
    [
        T.StructField(
            "documents",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("doc_type", T.StringType()),
                        T.StructField("required", T.ArrayType(T.StringType())),
                    ]
                ),
            ),
        ),
        T.StructField(
            "questions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("q", T.StringType()),
                        T.StructField("expect_docs", T.ArrayType(T.StringType())),
                        T.StructField("in_corpus", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)

# A field is text, an ISO date, a list of texts, or one of a closed set of values.
TEXT, DATE, TEXTS = "text", "date", "texts"

DOC_TYPES: dict[str, dict[str, object]] = {
    fixed.GENERIC_TYPE: {"summary": TEXT, "language": TEXT},
    "regulation": {
        "owner": TEXT,
        "department": TEXT,
        "effective_date": DATE,
        "review_by": DATE,
        "status": fixed.REGULATION_STATUSES,
        "summary": TEXT,
    },
    "instruction": {"topic": TEXT, "audience": TEXT, "systems": TEXTS, "summary": TEXT},
    "faq": {"topic": TEXT, "questions": TEXTS},
    "meeting_notes": {
        "meeting_date": DATE,
        "participants": TEXTS,
        "decisions": TEXTS,
        "action_items": TEXTS,
        "project": TEXT,
    },
}

MEETING_ATTRIBUTES = T.StructType(
    [
        T.StructField("meeting_date", T.StringType()),
        T.StructField("participants", T.ArrayType(T.StringType())),
        T.StructField("decisions", T.ArrayType(T.StringType())),
        T.StructField("action_items", T.ArrayType(T.StringType())),
    ]
)
