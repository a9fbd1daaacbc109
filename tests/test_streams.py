"""Streams run to completion over files, against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import sessions as S
from lorehouse.streaming import ingest as I
from lorehouse.streaming import sessions as R

T0 = datetime(2024, 1, 1, 12)
EVENTS = "user_id long, ts timestamp, id long, kind string, text string"


def minutes(n):
    return T0 + timedelta(minutes=n)


@pytest.fixture
def arrive(spark, tmp_path):
    """Write rows as new files of a folder and return the stream over it."""
    folder = str(tmp_path / "in")

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)

    return add


def test_texts_become_one_fact(spark, arrive, tmp_path):
    rows = [(1, minutes(0), 1, "text", "a"), (1, minutes(60), 2, "text", "b"), (1, minutes(121), 3, "text", "c"), (2, minutes(400), 4, "text", "z")]
    stream = R.idle_sessions(arrive(rows, EVENTS))
    R.run_available(stream, str(tmp_path / "out"))
    got = {(r.user_id, r.content) for r in R.read_results(stream, str(tmp_path / "out")).collect()}
    assert got == {(1, "a\n\nb"), (1, "c")}
    batch = S.idle_sessions(spark.createDataFrame(rows, EVENTS))
    assert {(r.user_id, r.events) for r in batch.collect()} == {(1, 2), (1, 1), (2, 1)}


TOGGLES = [
    (1, minutes(0), 1, "text", "outside"), (1, minutes(1), 2, "toggle", ""), (1, minutes(2), 3, "text", "a"),
    (1, minutes(3), 4, "document", ""), (1, minutes(4), 5, "toggle", ""), (1, minutes(5), 6, "toggle", ""),
    (1, minutes(65), 7, "document", ""), (1, minutes(126), 8, "text", "late"), (1, minutes(127), 9, "toggle", ""),
    (1, minutes(128), 10, "toggle", ""), (2, minutes(500), 11, "toggle", ""),
]


def test_toggle_sessions(spark, arrive, tmp_path):
    batch = S.toggle_sessions(spark.createDataFrame(TOGGLES, EVENTS))
    expected = {
        (1, minutes(1), minutes(4), "toggle", 1, 1, "saved"),
        (1, minutes(5), minutes(126), "idle", 0, 1, "documents"),
        (1, minutes(127), minutes(128), "toggle", 0, 0, "empty"),
    }
    columns = ("user_id", "opened_at", "closed_at", "ending", "texts", "documents", "outcome")
    got = {tuple(r[c] for c in columns) for r in batch.collect()}
    assert got == expected | {(2, minutes(500), None, "open", 0, 0, None)}
    out = str(tmp_path / "out")
    # state is carried over three arrivals
    for part in (TOGGLES[:3], TOGGLES[3:7], TOGGLES[7:]):
        stream = R.toggle_sessions(arrive(part, EVENTS), late="2 hours")
        R.run_available(stream, out)
    assert {tuple(r[c] for c in columns) for r in R.read_results(stream, out).collect()} == expected
    states = {r.id: r.state for r in S.toggle_states(spark.createDataFrame(TOGGLES, EVENTS)).collect()}
    assert (states[1], states[3], states[4], states[8]) == ("outside", "buffered", "attached", "outside")


def test_routes(spark):
    rows = [(1, minutes(0), 1, False, "вопрос?"), (1, minutes(1), 2, True, ""), (1, minutes(2), 3, False, "в буфер"),
            (1, minutes(3), 4, False, "https://a.b https://c.d"), (1, minutes(70), 5, False, "снова вопрос")]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, id long, is_toggle boolean, text string")
    assert {r.id: r.route for r in S.route_messages(frame).collect()} == {1: "question", 3: "buffer", 4: "page", 5: "question"}


def test_incremental_ingest_and_replay(spark, arrive, tmp_path):
    schema = "source_path string, title string, text string, source_kind string, seq long"
    folder = str(tmp_path / "state")
    for batch in ([("a", "A", "one", "file", 1), ("b", "B", "two", "file", 2)], [("a", "A", "one", "file", 3)], [("a", "A", "new", "file", 4)]):
        I.ingest_documents(arrive(batch, schema), folder, T0)
    versions = [
        {r.source_path: (r.id, r.version) for r in I.state(spark, folder, "documents", n, I.DOCUMENTS).collect()} for n in range(3)
    ]
    assert versions == [{"a": (1, 1), "b": (2, 1)}] * 2 + [{"a": (1, 2), "b": (2, 1)}]


def test_fact_stream_places_late_rows(spark, arrive, tmp_path):
    schema = "id long, topic string, content string, valid_from timestamp"
    folder = str(tmp_path / "facts")
    for batch in ([(1, "t", "a", minutes(0)), (2, "t", "b", minutes(200))], [(3, "t", "late", minutes(100))]):
        I.ingest_facts(arrive(batch, schema), folder)
    got = {r.id: r.invalid_at for r in I.state(spark, folder, "facts", 1, I.FACTS).collect()}
    assert got == {1: minutes(100), 3: minutes(200), 2: None}


def test_context_spend_and_segments(spark, arrive, tmp_path):
    schema = "conversation_id long, id long, role string, text string, usage string, created_at timestamp, user_id long, ts timestamp, is_reset boolean"
    def row(i, reset=False):
        return (1, i, "user", f"m{i}", '{"cost":2.5}', minutes(i), 1, minutes(i), reset)

    for part in ([row(i) for i in range(5)], [row(5, True), row(6, True), *[row(i) for i in range(7, 12)]]):
        stream = arrive(part, schema)
        R.run_available(R.rolling_context(stream, 3), str(tmp_path / "c"), "update")
        R.run_available(R.running_month_spend(stream, 20.0), str(tmp_path / "m"), "update")
        R.run_available(R.conversation_segments(stream), str(tmp_path / "s"))
    context = R.read_results(stream, str(tmp_path / "c"), latest=["conversation_id"])
    assert sorted(r.id for r in context.collect()) == [9, 10, 11]
    spend = R.read_results(stream, str(tmp_path / "m"), latest=["month"]).first()
    assert (spend.cost, spend.limited) == (30.0, True)
    segments = {r.id: r.segment for r in R.read_results(stream, str(tmp_path / "s")).collect()}
    assert segments == {**dict.fromkeys(range(5), 1), **dict.fromkeys(range(7, 12), 2)}
