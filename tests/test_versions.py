"""Versioned documents, bitemporal tables, ordered scans and extraction rules."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import extraction as X
from lorehouse.operators import history as H
from lorehouse.operators import versions as V
from lorehouse.operators.ordered import dense_ids, id_bucket, neighbour, running_total

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)
SPAN = "valid_from timestamp, invalid_at timestamp"


def at(moment):
    return F.lit(moment).cast("timestamp")


def counts(rows, **where):
    for key, value in where.items():
        rows = rows.filter(F.col(key) == value)
    return rows.filter("invalid_at is null").count(), rows.count()


def test_ordered_scans_with_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 5)) for i in rng.sample(range(500), 300)]
    frame = spark.createDataFrame(rows, "key string, n long, v long")
    bucket = id_bucket(F.col("n"), 20)
    total = running_total(frame, ["key"], ["n"], bucket, F.col("v"), "total")
    before = neighbour(frame, ["key"], ["n"], bucket, F.col("v"), "before")
    after = neighbour(frame, ["key"], ["n"], bucket, F.col("v"), "after", step=1)
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((n, v) for k, n, v in rows if k == key)
        for i, (n, v) in enumerate(mine):
            expected[n] = (
                sum(x for _, x in mine[: i + 1]),
                mine[i - 1][1] if i else None,
                mine[i + 1][1] if i + 1 < len(mine) else None,
            )
    got = {r.n: (r.total, None, None) for r in total.collect()}
    assert {n: t for n, (t, _, _) in got.items()} == {n: t for n, (t, _, _) in expected.items()}
    assert {r.n: r.before for r in before.collect()} == {n: b for n, (_, b, _) in expected.items()}
    assert {r.n: r.after for r in after.collect()} == {n: a for n, (_, _, a) in expected.items()}


def test_dense_ids(spark):
    frame = spark.createDataFrame([(f"p{i:04d}",) for i in range(200)], "path string").repartition(7)
    got = sorted((r.path, r.id) for r in dense_ids(frame, ["path"], "id", start=11).collect())
    assert [i for _, i in got] == list(range(11, 211))


DOCS = (
    "id long, source_path string, source_kind string, created_at timestamp, title string, content_hash string, "
    "raw_content string, doc_type string, attributes string, extraction_status string, extraction_model string, "
    "version int, ingest_session_id long, extracted_at timestamp"
)


def load(spark, current, rows, moment, session=None):
    incoming = spark.createDataFrame(rows, "source_path string, title string, text string, source_kind string")
    planned = V.plan_ingest(incoming, current).select(
        "*", F.lit("generic").alias("doc_type"), F.lit("{}").alias("attributes"), F.lit("done").alias("extraction_status"),
        F.lit("m").alias("extraction_model"), F.lit(session).cast("bigint").alias("ingest_session_id"),
    )
    return planned, V.apply_documents(current, planned, at(moment))


def test_idempotent_ingest(spark):
    empty = spark.createDataFrame([], DOCS)
    plan, first = load(spark, empty, [("a", "A", "one", "file"), ("b", "B", "two", "url")], T0, session=5)
    assert {r.source_path: (r.action, r.version) for r in plan.collect()} == {"a": ("created", 1), "b": ("created", 1)}
    plan, again = load(spark, first, [("a", "A", "one", "file")], T1)
    assert [r.action for r in plan.collect()] == ["unchanged"]
    assert sorted(map(str, again.collect())) == sorted(map(str, first.select(*again.columns).collect()))
    _, second = load(spark, first, [("a", "A2", "changed", "file"), ("c", "C", "new", "file")], T1)
    rows = {r.source_path: r for r in second.collect()}
    assert (rows["a"].version, rows["a"].title, rows["a"].created_at, rows["a"].extracted_at) == (2, "A2", T0, T1)
    assert rows["a"].ingest_session_id == 5 and rows["b"].version == 1
    assert (rows["c"].id, rows["c"].created_at) == (3, T1)


def test_version_chain_of_one_batch(spark):
    loads = [("s", 1, "x"), ("s", 2, "x"), ("s", 3, "y"), ("s", 4, "x"), ("t", 1, "x")]
    frame = spark.createDataFrame(loads, "source_path string, seq long, text string")
    got = {(r.source_path, r.seq): (r.action, r.version) for r in V.fold_versions(frame).collect()}
    assert got == {
        ("s", 1): ("created", 1), ("s", 2): ("unchanged", 1), ("s", 3): ("updated", 2), ("s", 4): ("updated", 3),
        ("t", 1): ("created", 1),
    }


def test_mentions_keep_history(spark):
    table = spark.createDataFrame([], "entity_id long, document_id long, role string, " + SPAN)
    changed = spark.createDataFrame([(1,)], "document_id long")
    wanted = spark.createDataFrame([(5, 1, None), (5, 1, None), (6, 1, "owner")], "entity_id long, document_id long, role string")
    once = V.replace_mentions(table, changed, wanted, at(T0))
    assert counts(once) == (2, 2)
    twice = V.replace_mentions(once, changed, wanted.filter("entity_id = 5"), at(T1))
    assert counts(twice, entity_id=5) == (1, 2)
    assert counts(twice, entity_id=6) == (0, 1)
    other = V.replace_mentions(once, spark.createDataFrame([(2,)], "document_id long"), wanted.limit(0), at(T1))
    assert counts(other) == (2, 2)


def test_relations_reactivate_in_place(spark):
    table = spark.createDataFrame([], "source_id long, target_id long, relation string, document_id long, " + SPAN)
    changed = spark.createDataFrame([(1,)], "document_id long")

    def want(*rows):
        return spark.createDataFrame(list(rows), "source_id long, target_id long, relation string, document_id long")

    one = V.replace_relations(table, changed, want((1, 2, "r", 1), (1, 1, "r", 1), (2, 3, "r", 1)), at(T0))
    assert counts(one) == (2, 2)
    two = V.replace_relations(one, changed, want((2, 3, "r", 1)), at(T1))
    assert counts(two) == (1, 2)
    three = V.replace_relations(two, changed, want((1, 2, "r", 1)), at(T2))
    rows = {(r.source_id, r.target_id): (r.valid_from, r.invalid_at) for r in three.collect()}
    assert rows == {(1, 2): (T2, None), (2, 3): (T1, T2)}


def test_links_removed_and_added_again(spark):
    links = spark.createDataFrame([], "source_id long, target_id long, kind string, " + SPAN)
    pending = spark.createDataFrame([], "source_id long, target_name string, kind string")
    docs = spark.createDataFrame([(1, "one", "p1"), (2, "two", "p2")], "id long, title string, source_path string")
    changed = spark.createDataFrame([(1,)], "document_id long")

    def names(*rows):
        return spark.createDataFrame(list(rows), "source_id long, name string")

    links, pending = V.replace_links(links, pending, changed, names((1, "TWO"), (1, "later")), docs, at(T0))
    assert counts(links) == (1, 1) and [r.target_name for r in pending.collect()] == ["later"]
    gone, none = V.replace_links(links, pending, changed, names((1, "one")), docs, at(T1))
    assert counts(gone) == (0, 1) and none.count() == 0
    back, _ = V.replace_links(gone, none, changed, names((1, "two")), docs, at(T2))
    assert counts(back) == (1, 2)
    more = docs.union(spark.createDataFrame([(3, "Later", "p3")], docs.schema))
    new = spark.createDataFrame([(3,)], "document_id long")
    found, rest = V.replace_links(links, pending, new, names((3, "nothing")), more, at(T1))
    assert {(r.source_id, r.target_id) for r in found.collect()} == {(1, 2), (1, 3)}
    assert [(r.source_id, r.target_name) for r in rest.collect()] == [(3, "nothing")]


def test_facts(spark):
    table = spark.createDataFrame([(1, "t", "a", T0, None)], "id long, topic string, content string, " + SPAN)
    new = spark.createDataFrame([(2, "t", "b", T1), (3, "u", "c", T1)], "id long, topic string, content string, valid_from timestamp")
    after = V.upsert_facts(table, new)
    assert {r.id: r.invalid_at for r in after.collect()} == {1: T1, 2: None, 3: None}
    late = spark.createDataFrame([(4, "t", "between", T0 + timedelta(hours=5))], new.schema)
    fixed = {r.id: r.invalid_at for r in V.upsert_facts(after, late).collect()}
    assert fixed == {1: T0 + timedelta(hours=5), 4: T1, 2: None, 3: None}
    assert {r.id for r in V.as_of(after, at(T0 + timedelta(hours=1))).collect()} == {1}
    soft = V.soft_delete(after, spark.createDataFrame([("t",)], "topic string"), at(T2))
    assert {r.id: r.invalid_at for r in soft.collect()} == {1: T1, 2: T2, 3: None}
    assert {r.id for r in V.hard_delete(after, spark.createDataFrame([("t",)], "topic string")).collect()} == {3}
    history = {r.id: (r.number, r.until) for r in H.fact_history(after).collect()}
    assert history == {1: (1, T1), 2: (2, None), 3: (1, None)}


def test_entities_and_orphans(spark):
    current = spark.createDataFrame([(4, "person", "ann", "ann", '{"x":1}')], "id long, entity_type string, name string, canonical string, attributes string")
    named = spark.createDataFrame([("person", " Ann", 1), ("person", "ANN", 2), ("product", "Ann", 1)], "entity_type string, name string, seq int")
    after = V.upsert_entities(current, named)
    assert {(r.id, r.entity_type, r.name, r.attributes) for r in after.collect()} == {(4, "person", "ANN", '{"x":1}'), (5, "product", "Ann", "{}")}
    mentions = spark.createDataFrame([(4, T1)], "entity_id long, invalid_at timestamp")
    relations = spark.createDataFrame([], "source_id long, target_id long")
    assert [r.id for r in V.drop_orphans(after, mentions, relations).collect()] == [4]
    assert [r.id for r in V.orphans(after, mentions, relations).collect()] == [5]


def test_set_type_and_report(spark):
    docs = spark.createDataFrame(
        [(1, "generic", "{}", "pending", None, None), (2, "generic", "{}", "pending", None, None)],
        "id long, doc_type string, attributes string, extraction_status string, extraction_model string, extracted_at timestamp",
    )
    found = spark.createDataFrame(
        [(1, "faq", '{"topic":"x"}', "done", "m"), (2, "generic", '{"summary":"x"}', "done", "m")],
        "document_id long, doc_type string, attributes string, status string, model string",
    )
    forced = spark.createDataFrame([(1, "faq"), (2, "faq")], "document_id long, doc_type string")
    rows = {r.id: (r.doc_type, r.attributes, r.extraction_status, r.extraction_model) for r in V.set_type(docs, forced, found, at(T0)).collect()}
    assert rows == {1: ("faq", '{"topic":"x"}', "done", "m"), 2: ("faq", "{}", "skipped", None)}
    facts = spark.createDataFrame([("t", None), ("t", None), ("u", T0), ("u", None)], "topic string, invalid_at timestamp")
    assert [r.violations for r in V.integrity_report({"facts": facts}).collect()] == [1]


def envelope(**changes):
    base = {"doc_type": "regulation", "confidence": 0.9, "attributes": {"status": "active", "review_by": "2024-05-01", "junk": 1},
            "entities": [{"entity_type": "person", "name": "Ann", "role": ""}, {"name": "x"}, 5], "relations": [], "links": ["a", ""]}
    return json.dumps({**base, **changes})


@pytest.mark.parametrize(
    ("attempts", "expected"),
    [
        ([envelope()], ("regulation", 0.9, "done", 1)),
        ([envelope(confidence=0.3)], ("generic", 0.3, "done", 1)),
        ([envelope(confidence="high")], ("generic", 0.0, "done", 1)),
        ([envelope(doc_type="memo")], ("generic", 0.9, "done", 1)),
        ([envelope(attributes={"status": "bogus"}), envelope()], ("regulation", 0.9, "done", 1)),
        ([envelope(attributes={"review_by": "2024-13-01"}), None], ("generic", 0.0, "failed", 1)),
        ([envelope(attributes={"owner": 5}), "junk"], ("generic", 0.0, "failed", 0)),
        (["junk", "[1]"], ("generic", 0.0, "failed", 0)),
        ([None, envelope()], ("regulation", 0.9, "done", 1)),
        (["junk", "junk", envelope()], ("generic", 0.0, "failed", 0)),
        ([envelope(attributes=None)], ("regulation", 0.9, "done", 1)),
    ],
)
def test_extraction_attempts(spark, attempts, expected):
    raw = spark.createDataFrame([(1, i, a) for i, a in enumerate(attempts)], "document_id long, attempt int, raw_json string")
    result = X.normalize_extractions(raw)
    row = result.first()
    assert (row.doc_type, row.confidence, row.status, X.extracted_entities(result).count()) == expected
    if expected[0] == "regulation" and "junk" in (attempts[-1] or ""):
        assert json.loads(row.attributes) == {"status": "active", "review_by": "2024-05-01"}


def test_histories(spark):
    messages = spark.createDataFrame([(i, i % 2, f"m{i}") for i in range(30)], "id long, conversation_id long, text string")
    got = sorted((r.conversation_id, r.place, r.id) for r in H.last_messages(messages, 3).collect())
    assert got == [(0, 1, 24), (0, 2, 26), (0, 3, 28), (1, 1, 25), (1, 2, 27), (1, 3, 29)]
    arrivals = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, session_id long")
    held = spark.createDataFrame([(7, 4)], "session_id long, seq long")
    assert {r.id: r.seq for r in H.assign_seq(arrivals, held).collect()} == {1: 5, 2: 6, 3: 1}
    talks = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 2, False)], "id long, user_id long, active boolean")
    assert {r.id: r.active for r in H.keep_newest_active(talks).collect()} == {1: False, 2: True, 3: False}
