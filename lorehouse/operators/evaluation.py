"""Quality metrics over labels, questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import categorize_answer, terms
from lorehouse.operators.rare_key import candidates
from lorehouse.session import cut_lineage


def label_lookup(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Labels with the document of the same title in any case; lowest id, missing ones skipped."""
    wanted = labels.select(F.lower("title").alias("_key")).distinct()
    found = (
        documents.withColumn("_key", F.lower("title"))
        .join(wanted, "_key", "left_semi")
        .groupBy("_key")
        .agg(
            F.min_by(F.struct("id", "doc_type", "attributes"), "id").alias("_doc"),
        )
    )
    return (
        labels.withColumn("_key", F.lower("title"))
        .join(found, "_key")
        .select(
            "title",
            F.col("doc_type").alias("label_type"),
            "required",
            F.col("_doc.id").alias("document_id"),
            F.col("_doc.doc_type").alias("doc_type"),
            F.col("_doc.attributes").alias("attributes"),
        )
    )


def type_accuracy(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of labelled documents of the right type; NULL without any."""
    right = F.col("doc_type").eqNullSafe(F.col("label_type"))
    return label_lookup(labels, documents).agg(F.avg(right.cast("double")).alias("type_accuracy"))


def attribute_completeness(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of required attributes that are present: not null, empty text or empty list."""
    needed = label_lookup(labels, documents).select(
        F.explode("required").alias("field"), F.from_json("attributes", "map<string,string>").alias("have")
    )
    value = F.try_element_at("have", F.col("field"))
    present = value.isNotNull() & ~value.isin("", "[]")
    return needed.agg(F.avg(present.cast("double")).alias("attribute_completeness"))


def question_hits(questions: DataFrame, results: DataFrame) -> DataFrame:
    """``(question_id, hit)``: whether an expected title or numeric id is among the results.

    ``questions``: question_id, expect_docs. ``results``: question_id,
    document_id, document.
    """
    expected = questions.select("question_id", F.explode("expect_docs").alias("want"))
    return expected_hits(questions, expected, results)


def expected_hits(questions: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """``question_hits`` with one row ``(question_id, want)`` per expected document, however many there are."""
    names = results.select("question_id", F.col("document").alias("want"))
    ids = results.select("question_id", F.col("document_id").cast("string").alias("want"))
    number = F.when(F.col("want").rlike(r"^\d+$"), F.col("want").try_cast("bigint").cast("string"))
    asked = expected.unionByName(expected.select("question_id", number.alias("want")))
    hit = asked.filter(F.col("want").isNotNull()).join(names.unionByName(ids).distinct(), ["question_id", "want"], "left_semi")
    hit = hit.select("question_id").distinct().withColumn("hit", F.lit(True))
    return questions.select("question_id").join(hit, "question_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def passage_holders(passages: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, id)``: documents that hold the text of a passage character by character.

    ``passages``: query_id, text. ``documents``: id, raw_content. ``chunks``: document_id
    and tokens, with every word of the documents. Documents with the rarest inner word of a
    passage are few and are compared whole. The first and the last word are no inner ones,
    they may go on outside of the passage; nor is a word with a sigma, whose lower case
    depends on what follows. Passages without inner words are compared with every document.
    """
    words = terms(F.col("text"))
    inner = F.filter(
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda word: ~word.rlike("[σς]")
    )
    asked = cut_lineage(passages.select("query_id", "text", F.array_distinct(inner).alias("inner")), "passages")
    needs = asked.select("query_id", F.explode("inner").alias("key"))
    held = chunks.select(F.explode_outer("tokens").alias("key"), F.col("document_id").alias("item"))
    near = candidates(needs, held.filter(F.col("key").isNotNull()), ["query_id"])
    # written, so that few pairs are broadcast to the documents instead of shuffling these
    near = cut_lineage(near.select("query_id", F.col("item").alias("id")).distinct(), "near")
    wordless = cut_lineage(asked.filter(F.size("inner") == 0).select("query_id", "text"), "wordless")
    texts = documents.select("id", "raw_content")
    pairs = texts.join(near, "id").join(asked.select("query_id", "text"), "query_id")
    pairs = pairs.unionByName(texts.crossJoin(wordless))
    return pairs.filter(F.contains("raw_content", "text")).select("query_id", "id")


def recall_at_k(questions: DataFrame, results: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Share of questions with at least one expected document among the results.

    The expected documents stand in ``expect_docs`` or, one per row, in ``expected``.
    """
    hits = question_hits(questions, results) if expected is None else expected_hits(questions, expected, results)
    return hits.agg(F.avg(F.col("hit").cast("double")).alias("recall_at_4"))


def refusal_rate(answers: DataFrame) -> DataFrame:
    """Share of answers that refuse."""
    refused = F.contains(F.lower("answer"), F.lit(fixed.REFUSAL_PHRASE))
    return answers.agg(F.avg(refused.cast("double")).alias("refusals"))


def eval_report(results: DataFrame) -> DataFrame:
    """``(metric, label, n, of, percent)`` over answered benchmark questions.

    ``results``: out_of_corpus, answer, verdict. Percentages are rounded down.
    """
    rows = results.withColumn("category", categorize_answer(F.col("answer")))
    inside, outside = ~F.col("out_of_corpus"), F.col("out_of_corpus")
    deflected = F.col("category").isin("refused", "clarification")
    tried = F.col("verdict").isin("correct", "partial", "incorrect")
    counts = rows.agg(
        F.count_if(inside).alias("inside"),
        F.count_if(outside).alias("outside"),
        F.count_if(inside & deflected).alias("deflected"),
        F.count_if(outside & (F.col("category") == "refused")).alias("refused"),
        F.count_if(inside & tried).alias("tried"),
        F.count_if(inside & (F.col("verdict") == "correct")).alias("correct"),
    )

    def line(metric: str, n: str, of: str):
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(None).cast("string").alias("label"),
            F.col(n).alias("n"),
            F.col(of).alias("of"),
        )

    summary = counts.select(
        F.explode(
            F.array(
                line("in-corpus deflection", "deflected", "inside"),
                line("out-of-corpus refusals", "refused", "outside"),
                line("in-corpus correct", "correct", "tried"),
            )
        ).alias("row")
    ).select("row.*")

    def breakdown(metric: str, column: str) -> DataFrame:
        return rows.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(metric).alias("metric"), "label", "n", F.lit(None).cast("bigint").alias("of")
        )

    return (
        summary.unionByName(breakdown("category", "category"))
        .unionByName(breakdown("verdict", "verdict"))
        .withColumn("percent", F.when(F.col("of") > 0, F.floor(F.col("n") * 100 / F.col("of"))))
    )


def threshold_table(spark: SparkSession) -> DataFrame:
    """Target of every metric."""
    return spark.createDataFrame(list(fixed.THRESHOLDS), "metric string, threshold double")


def threshold_gate(metrics: DataFrame) -> DataFrame:
    """``(metric, value, threshold, verdict)``; a metric without a value is n/a.

    ``metrics``: metric, value.
    """
    targets = threshold_table(metrics.sparkSession)
    verdict = (
        F.when(F.col("value").isNull(), "n/a")
        .when(F.col("value") >= F.col("threshold"), "ok")
        .otherwise("FAIL")
    )
    return targets.join(metrics, "metric", "left").withColumn("verdict", verdict)
