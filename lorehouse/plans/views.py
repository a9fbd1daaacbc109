"""Views of the given Parquet tables.

``Tables`` builds them with Spark; ``PRELUDE`` defines the same tables in SQL
for the check. Only the mapping of inputs is shared, never an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse.functions.text import canonical_name, content_hash
from lorehouse.operators.chunking import chunk_documents
from lorehouse.operators.versions import close_intervals
from lorehouse.session import spread

TYPES = ("generic", "regulation", "instruction", "faq", "meeting_notes")
CLAIMED = (*TYPES, "memo")
AS_OF = "2024-01-20 12:00:00"
#: Files that a micro-batch of a stream takes.
TRIGGER_FILES = 8


def _json(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _choice(number: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


class Tables:
    """Derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        plain = [f.name for f in table.schema if isinstance(f.dataType, T.TimestampNTZType)]
        table = table.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else table
        # long texts are costly per row, so they are spread before they are worked on
        return spread(table) if name in ("documents", "pages") else table

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files, ``TRIGGER_FILES`` per micro-batch.

        The glob matches the table itself, be it one file or a folder of part files.
        """
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        rows = (
            self.spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", TRIGGER_FILES)
            .parquet(f"{self.folder}/{name}[.]parquet")
        )
        plain = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
        return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else rows

    # --- documents ---------------------------------------------------------------

    def documents(self) -> DataFrame:
        d = self.raw("documents")
        n = F.col("doc_id")
        review = F.when(n % 6 == 0, "soon").otherwise(
            F.date_add(F.lit("2024-01-01").cast("date"), (n % 700).cast("int")).cast("string")
        )
        attributes = _json(
            '{"lang":"', F.col("lang"), '","owner":"', F.col("source"), '","status":"',
            _choice(n, ("active", "draft", "deprecated")), '","review_by":"', review,
            '","n_chars":', F.col("n_chars"), ',"tags":["', F.col("lang"), '","t', n % 7,
            '"],"meta":{"bucket":', n % 10, "}}",
        )
        return d.select(
            n.alias("id"),
            F.concat(F.lit("Doc "), n).alias("title"),
            F.concat_ws("/", "source", n).alias("source_path"),
            F.when(n % 4 == 0, "url").otherwise("file").alias("source_kind"),
            F.col("text").alias("raw_content"),
            content_hash(F.col("text")).alias("content_hash"),
            F.lit(1).alias("version"),
            _choice(n, TYPES).alias("doc_type"),
            attributes.alias("attributes"),
            _choice(n, ("pending", "failed", "skipped", "done", "done", "done", "done")).alias("extraction_status"),
            F.when(n % 3 == 1, "model-a").when(n % 3 == 2, "model-b").alias("extraction_model"),
            F.lit(None).cast("timestamp").alias("extracted_at"),
            F.timestamp_add("HOUR", n, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
            F.when(n % 3 == 0, F.floor(n / 3)).alias("ingest_session_id"),
            F.col("lang"),
            F.col("source"),
        )

    def structured_documents(self) -> DataFrame:
        """Documents with paragraphs, headings, questions or meeting attributes by type."""
        d = self.documents()
        paragraphs = F.replace("raw_content", F.lit("\n"), F.lit("\n\n"))
        heads = F.concat(F.lit("# "), F.replace("raw_content", F.lit("\n"), F.lit("\n\n## ")))
        asked = F.concat(F.lit("### "), F.replace("raw_content", F.lit("\n"), F.lit("\n\n### ")))
        text = (
            F.when(F.col("doc_type") == "regulation", heads)
            .when(F.col("doc_type") == "faq", asked)
            .otherwise(paragraphs)
        )
        notes = F.to_json(
            F.struct(
                F.lit("2024-05-12").alias("meeting_date"),
                F.array("lang", "source").alias("participants"),
                F.split("raw_content", "\n").alias("decisions"),
            )
        )
        meeting = (F.col("doc_type") == "meeting_notes") & (F.col("id") % 10 == 4)
        return d.select(
            "id", "doc_type", text.alias("raw_content"), F.when(meeting, notes).otherwise("{}").alias("attributes")
        )

    def chunks(self) -> DataFrame:
        d = self.documents().withColumn("doc_type", F.lit("generic"))
        c = chunk_documents(d)
        return c.withColumn("chunk_id", F.col("document_id") * 1_000_000 + F.col("chunk_index"))

    def loads(self) -> DataFrame:
        """Two loads: the labelled documents, then all of them with some edited."""
        d = self.raw("documents").withColumn("source_path", F.col("doc_id").cast("string"))
        labelled = d.join(self.raw("labels").select("doc_id"), "doc_id", "left_semi")
        first = labelled.select("source_path", F.lit(1).alias("seq"), "text")
        edited = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        return first.unionByName(d.select("source_path", F.lit(2).alias("seq"), edited.alias("text")))

    def current_documents(self) -> DataFrame:
        """State after the first load."""
        first = self.loads().filter("seq = 1")
        n = F.col("source_path").cast("bigint")
        return first.select(
            n.alias("id"),
            "source_path",
            F.lit("file").alias("source_kind"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
            F.concat(F.lit("Doc "), n).alias("title"),
            content_hash(F.col("text")).alias("content_hash"),
            F.col("text").alias("raw_content"),
            F.lit("generic").alias("doc_type"),
            F.lit("{}").alias("attributes"),
            F.lit("pending").alias("extraction_status"),
            F.lit(None).cast("string").alias("extraction_model"),
            F.lit(1).alias("version"),
            F.lit(7).cast("bigint").alias("ingest_session_id"),
            F.lit(None).cast("timestamp").alias("extracted_at"),
        )

    def incoming_documents(self) -> DataFrame:
        second = self.loads().filter("seq = 2")
        return second.select(
            "source_path",
            F.concat(F.lit("Doc "), "source_path", F.lit(" v2")).alias("title"),
            "text",
            F.lit("file").alias("source_kind"),
        )

    # --- entities and edges ----------------------------------------------------------

    def entities(self) -> DataFrame:
        def kind(table: str, key: str, code: int, label: str, name: Column) -> DataFrame:
            return self.raw(table).select(
                (F.col(key).cast("bigint") * 8 + code).alias("id"),
                F.lit(label).alias("entity_type"),
                name.alias("name"),
            )

        rows = (
            kind("region", "r_regionkey", 1, "department", F.col("r_name"))
            .unionByName(kind("nation", "n_nationkey", 2, "project", F.col("n_name")))
            .unionByName(kind("supplier", "s_suppkey", 3, "person", F.col("s_name")))
            .unionByName(kind("customer", "c_custkey", 4, "person", F.col("c_name")))
            .unionByName(kind("part", "p_partkey", 5, "product", F.concat_ws(" ", "p_name", "p_partkey")))
        )
        return rows.withColumn("canonical", canonical_name(F.col("name"))).withColumn(
            "attributes", F.lit("{}")
        )

    def relations(self) -> DataFrame:
        def edge(table: DataFrame, source: Column, target: Column, relation: str, document: Column,
                 invalid: Column) -> DataFrame:
            return table.select(
                source.cast("bigint").alias("source_id"),
                target.cast("bigint").alias("target_id"),
                F.lit(relation).alias("relation"),
                document.cast("bigint").alias("document_id"),
                F.lit("1995-01-01 00:00:00").cast("timestamp").alias("valid_from"),
                invalid.cast("timestamp").alias("invalid_at"),
            )

        def key(column: str, code: int) -> Column:
            return F.col(column).cast("bigint") * 8 + code

        never = F.lit(None)
        sold = (
            self.raw("lineitem")
            .groupBy("l_suppkey", "l_partkey", "l_orderkey")
            .agg(F.min("l_returnflag").alias("low"), F.max("l_shipdate").alias("until"))
        )
        gone = F.when(F.col("low") == "R", F.col("until"))
        left = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("1998-01-01 00:00:00"))
        return (
            edge(self.raw("supplier"), key("s_suppkey", 3), key("s_nationkey", 2), "part_of", F.col("s_suppkey"), never)
            .unionByName(edge(self.raw("nation"), key("n_nationkey", 2), key("n_regionkey", 1), "part_of", F.col("n_nationkey"), never))
            .unionByName(edge(self.raw("customer"), key("c_custkey", 4), key("c_nationkey", 2), "reports_to", F.col("c_custkey"), left))
            .unionByName(edge(sold, key("l_suppkey", 3), key("l_partkey", 5), "related_to", F.col("l_orderkey"), gone))
        )

    def mentions(self) -> DataFrame:
        role = F.when(F.col("l_returnflag") == "A", "owner").when(F.col("l_returnflag") == "R", "approver")
        return (
            self.raw("lineitem")
            .groupBy(
                (F.col("l_suppkey") * 8 + 3).alias("entity_id"),
                F.col("l_orderkey").alias("document_id"),
                role.alias("role"),
            )
            .agg(
                F.min("l_shipdate").alias("valid_from"),
                F.when(F.max("l_linestatus") == "F", F.max("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("invalid_at"),
            )
        )

    def links(self) -> DataFrame:
        d = self.documents()
        kind = (
            F.when(F.col("id") % 11 == 0, "supersedes").when(F.col("id") % 5 == 0, "attachment").otherwise("reference")
        )
        target = F.floor(F.col("id") / 2)
        return d.filter(F.col("id") != target).select(
            F.col("id").alias("source_id"),
            target.alias("target_id"),
            kind.alias("kind"),
            F.col("created_at").alias("valid_from"),
            F.when(F.col("id") % 13 == 0, F.lit(AS_OF).cast("timestamp")).alias("invalid_at"),
        )

    def link_names(self) -> DataFrame:
        """Link targets by name: titles in another case, source paths, unknown names, itself."""
        n = F.col("id")
        other = F.floor(n / 3)
        name = (
            F.when(n % 4 == 0, F.concat(F.lit("DOC "), other))
            .when(n % 4 == 1, F.concat_ws("/", "source", n))
            .when(n % 4 == 2, F.concat(F.lit("doc "), n + 100_000_000))
            .otherwise(F.concat(F.lit("doc "), other))
        )
        return self.documents().select(n.alias("source_id"), name.alias("name"))

    def pending_links(self) -> DataFrame:
        n = F.col("id")
        name = F.when(n % 2 == 0, F.concat(F.lit("dOc "), n + 1)).otherwise(F.concat(F.lit("nothing "), n))
        return self.documents().select(
            n.alias("source_id"), name.alias("target_name"), F.lit("reference").alias("kind")
        )

    # --- people, messages, facts -------------------------------------------------------

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def users(self) -> DataFrame:
        return self.raw("events").select("user_id").distinct().select(
            F.col("user_id").alias("id"),
            (F.col("user_id") + 1000).alias("telegram_id"),
            F.concat(F.lit("user "), F.col("user_id") % 40).alias("name"),
        )

    def owners(self) -> DataFrame:
        """One conversation per user."""
        return self.users().select("id", F.col("id").alias("user_id"))

    @staticmethod
    def as_messages(events: DataFrame) -> DataFrame:
        model = F.when(F.col("event_type") == "signup", "").otherwise(
            _json('"model":"', F.col("event_type"), '",')
        )
        cost = (
            F.when(F.col("event_type") == "view", "")
            .when(F.col("event_type") == "error", '"cost":null,')
            .otherwise(_json('"cost":', F.col("value"), ","))
        )
        usage = _json(
            "{", model, cost, '"prompt_tokens":', F.col("k"), ',"completion_tokens":', F.col("event_id") % 100,
            ',"total_tokens":', F.col("k") + F.col("event_id") % 100, ',"prompt_tokens_details":{"cached_tokens":',
            F.col("k") % 10, '},"cache_write_tokens":', F.col("k") % 3, ',"cache_creation_input_tokens":',
            F.col("k") % 5, "}",
        )
        return events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("conversation_id"),
            F.lit("assistant").alias("role"),
            F.col("event_type").alias("content"),
            usage.alias("usage"),
            F.col("ts").alias("created_at"),
        )

    def messages(self) -> DataFrame:
        return self.as_messages(self.events())

    def facts(self) -> DataFrame:
        versions = self.events().select(
            F.col("event_id").alias("id"),
            F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("topic"),
            F.col("props").alias("content"),
            F.col("ts").alias("valid_from"),
            F.lit(None).cast("timestamp").alias("invalid_at"),
            F.col("user_id").alias("created_by"),
            F.floor(F.col("event_id") / 20).alias("session_id"),
        )
        return close_intervals(versions)

    def buffered(self) -> DataFrame:
        return self.events().select(
            F.floor(F.col("event_id") / 20).alias("session_id"),
            (F.col("event_id") % 20 + 1).alias("seq"),
            F.concat_ws(" ", "event_type", "props").alias("text"),
            "ts",
        )

    def sessions(self) -> DataFrame:
        return (
            self.events()
            .groupBy(F.floor(F.col("event_id") / 20).alias("id"))
            .agg(
                F.min("user_id").alias("user_id"),
                F.min("ts").alias("started_at"),
                F.max("ts").alias("last_active_at"),
            )
            .withColumn("active", F.col("id") % 3 == 0)
        )

    def session_events(self, events: DataFrame | None = None) -> DataFrame:
        """Capture events: sign-ups toggle, clicks and errors are texts, the rest documents."""
        events = self.raw("events") if events is None else events
        kind = (
            F.when(F.col("event_type") == "signup", "toggle")
            .when(F.col("event_type").isin("click", "error"), "text")
            .otherwise("document")
        )
        return events.select(
            "user_id", "ts", F.col("event_id").alias("id"), kind.alias("kind"),
            F.concat_ws(" ", "event_type", "props").alias("text"),
        )

    # --- extraction outputs -----------------------------------------------------------

    def raw_extractions(self) -> DataFrame:
        n, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
        confidence = (
            F.when(n % 7 == 0, "0.3").when(n % 7 == 1, '"0.9"').when(n % 7 == 2, "true")
            .when(n % 7 == 3, '"high"').otherwise("0.75")
        )
        review = F.when(n % 8 == 0, "2024-13-01").otherwise(_json("2024-0", n % 9 + 1, "-15"))
        attributes = _json(
            '{"owner":"', source, '","status":"', F.when(n % 5 == 0, "bogus").otherwise("active"),
            '","review_by":"', review, '","summary":null,"topic":"', source, '","systems":["a","', lang,
            '"],"questions":["q', n, '"],"meeting_date":"2024-02-0', n % 9 + 1, '","participants":[',
            F.when(n % 11 == 0, "1").otherwise('"p"'), '],"language":"', lang, '","extra":1}',
        )

        def envelope(confidence: Column, claimed: Column) -> Column:
            return _json(
                '{"doc_type":"', claimed, '","confidence":', confidence, ',"attributes":', attributes,
                ',"entities":[{"entity_type":"person","name":" Ann ', n % 50, ' ","role":"owner"},',
                '{"entity_type":"product","name":"', source, '","role":""},{"entity_type":"process","name":"',
                lang, '"},{"name":"no type"},7],"relations":[{"source":"ANN ', n % 50, '","target":"', source,
                '","relation":"owns"},{"source":"', source, '","target":"missing","relation":"owns"},',
                '{"source":"x"}],"links":["doc ', F.floor(n / 2), '","","doc ', n + 1, '"]}',
            )

        first = (
            F.when(n % 10 == 0, "not json").when(n % 10 == 1, "[1,2]").when(n % 10 == 2, F.lit(None))
            .otherwise(envelope(confidence, _choice(n, CLAIMED)))
        )
        second = F.when(n % 20 == 0, "{broken").otherwise(envelope(F.lit("0.8"), _choice(n + 1, CLAIMED)))
        d = self.raw("documents")
        one = d.select(n.alias("document_id"), F.lit(1).alias("attempt"), first.alias("raw_json"))
        two = d.select(n.alias("document_id"), F.lit(2).alias("attempt"), second.alias("raw_json"))
        return one.unionByName(two)

    # --- evaluation -------------------------------------------------------------------

    def labels(self) -> DataFrame:
        """Expected type and required attributes of the labelled documents."""
        n = F.col("doc_id")
        required = F.array(F.lit("owner"), F.when(F.col("quality") == 1, "status").otherwise("approver"))
        return self.raw("labels").select(
            F.concat(F.lit("DOC "), n).alias("title"),
            _choice(n + F.when(F.col("toxic") == 1, 1).otherwise(0), TYPES).alias("doc_type"),
            required.alias("required"),
        )

    def answers(self) -> DataFrame:
        """Answered questions from the conversation turns of the assistant."""
        n, t = F.col("conv_id"), F.col("turn")
        tail = (
            F.when((n + t) % 5 == 0, " В базе знаний этого нет.")
            .when((n + t) % 5 == 1, " Уточните вопрос.")
            .when((n + t) % 5 == 2, " Уточните, источник: Doc 1")
            .otherwise("")
        )
        verdict = _choice(
            n + t * 3, ("Correct", "partial, maybe", "the answer is INCORRECT", "hmm", "false_refusal correct", "correct_refusal")
        )
        return self.raw("conversations").filter(F.col("role") == "assistant").select(
            "conv_id", "turn", F.concat("text", tail).alias("answer"),
            (n % 6 == 0).alias("out_of_corpus"), verdict.alias("verdict_text"),
        )

    def questions(self) -> DataFrame:
        """Benchmark passages as questions."""
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def composed_queries(self) -> DataFrame:
        """Web-search style queries built from the words of each passage."""
        w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")

        def word(i: int) -> Column:
            return F.element_at(F.col("w"), i)

        query = F.concat(
            word(1), F.lit(" "), word(-1), F.lit(' or "'), word(2), F.lit(" "), word(3), F.lit('" -'), word(-2)
        )
        return self.raw("benchmark").withColumn("w", w).select(
            F.col("item_id").alias("query_id"), query.alias("query")
        )
