"""Walks, look-ups and name resolution against plain-Python models."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import graph as G
from lorehouse.operators import links as K

EDGES = "source_id long, target_id long, relation string, document_id long, invalid_at timestamp"


def edges(spark, pairs, gone=()):
    rows = [(a, b, "r", 1, None) for a, b in pairs] + [(a, b, "r", 1, datetime(2024, 1, 1)) for a, b in gone]
    return spark.createDataFrame(rows, EDGES)


def model_walk(pairs, root, depth):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, level = {root: 0}, [root]
    for step in range(1, depth + 1):
        level = sorted({n for v in level for n in near.get(v, ())} - set(seen))
        seen.update(dict.fromkeys(level, step))
    return seen


@pytest.fixture(scope="module")
def hub_graph():
    rng = random.Random(11)
    pairs = {(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(220)}
    pairs |= {(0, i) for i in range(1, 90)}  # a hub next to most vertices
    return sorted((a, b) for a, b in pairs if a != b)


@pytest.mark.parametrize("limit", [5, 40])
def test_bounded_walk_is_exact(spark, hub_graph, limit):
    roots = spark.range(0, 151).select(F.col("id").alias("root"))
    got = {}
    for row in G.first_reached(roots, edges(spark, hub_graph), 3, limit).collect():
        got.setdefault(row.root, set()).add((row.depth, row.id))
    for root in range(151):
        seen = sorted((d, i) for i, d in model_walk(hub_graph, root, 3).items())
        assert got[root] == set(seen[:limit]), root


def test_full_walk(spark, hub_graph):
    roots = spark.createDataFrame([(0,), (140,)], "root long")
    got = {(r.root, r.id): r.depth for r in G.walk(roots, edges(spark, hub_graph), 9).collect()}
    expected = {(root, i): d for root in (0, 140) for i, d in model_walk(hub_graph, root, 3).items()}
    assert got == expected


def test_ring_terminates_and_ignores_history(spark):
    entities = spark.createDataFrame([(i, "person", f"n{i}") for i in range(1, 5)], "id long, entity_type string, name string")
    ring = edges(spark, [(1, 2), (2, 3), (3, 1)], gone=[(3, 4)])
    nodes, lines = G.neighbors(spark.createDataFrame([(1,)], "root long"), entities, ring, 3)
    assert {(r.id, r.depth) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r.source, r.target) for r in lines.collect()} == {(1, 2), (2, 3), (3, 1)}
    alone, _ = G.neighbors(spark.createDataFrame([(1,)], "root long"), entities, ring, 0)
    assert [r.id for r in alone.collect()] == [1]


def test_induced_edges_match_brute_force(spark, hub_graph):
    roots = spark.range(0, 151).select(F.col("id").alias("root"))
    table = edges(spark, hub_graph + hub_graph[:20])
    nodes = G.first_reached(roots, table, 2, 12)
    got = sorted((r.root, r.source, r.target) for r in G.induced_edges(nodes, table).collect())
    sets = {}
    for r in nodes.collect():
        sets.setdefault(r.root, set()).add(r.id)
    expected = sorted(
        (root, a, b) for root, ids in sets.items() for a, b in hub_graph + hub_graph[:20] if a in ids and b in ids
    )
    assert got == expected


def test_related_documents_and_current(spark):
    docs = spark.createDataFrame([(i, f"d{i}", "faq", 1) for i in range(1, 5)], "id long, title string, doc_type string, version int")
    links = spark.createDataFrame(
        [(2, 1, "supersedes", None), (1, 3, "reference", None), (4, 1, "reference", datetime(2024, 1, 1))],
        "source_id long, target_id long, kind string, invalid_at timestamp",
    )
    got = {r.id: r.current for r in G.related_documents(spark.createDataFrame([(2,)], "root long"), docs, links, 1).collect()}
    assert got == {1: False}
    deep = {r.id: r.depth for r in G.related_documents(spark.createDataFrame([(2,)], "root long"), docs, links, 2).collect()}
    assert deep == {1: 1, 3: 2}


def test_find_entities_matches_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ab_%А ") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = [(i, "t", n, n.strip().lower(), "{}") for i, n in enumerate(names)]
    entities = spark.createDataFrame(rows, "id long, entity_type string, name string, canonical string, attributes string")
    asked = sorted({n[i:j] for n in names[:40] for i in range(len(n)) for j in range(i + 1, len(n) + 1)} | {"", "zz", "АБ", "aaaaaaaaaaaa"})
    got = {r.name: r.entity_id for r in G.find_entities(spark.createDataFrame([(a,) for a in asked], "name string"), entities).collect()}
    for name in asked:
        exact = [r[0] for r in rows if r[3] == name.strip().lower()]
        inside = [r[0] for r in rows if name.lower() in r[2].lower()]
        assert got.get(name) == min(exact or inside, default=None), name


def test_cards(spark):
    entities = spark.createDataFrame(
        [(1, "person", "Ann", "ann", "{}"), (2, "product", "Box", "box", "{}")],
        "id long, entity_type string, name string, canonical string, attributes string",
    )
    docs = spark.createDataFrame([(7, "T", "faq", 1)], "id long, title string, doc_type string, version int")
    mentions = spark.createDataFrame([(1, 7, "owner", None)], "entity_id long, document_id long, role string, invalid_at timestamp")
    names = spark.createDataFrame([("ann",), ("nobody",)], "name string")
    cards = G.entity_cards(names, entities, mentions, docs, edges(spark, [(1, 2)]))
    assert {r.name: r.entity_id for r in cards["entity"].collect()} == {"ann": 1, "nobody": None}
    assert [(r.name, r.id, r.role) for r in cards["documents"].collect()] == [("ann", 7, "owner")]
    assert {r.id for r in cards["nodes"].collect()} == {1, 2}
    assert cards["edges"].count() == 1
    chunks = spark.createDataFrame([(7,), (7,)], "document_id long")
    links = spark.createDataFrame([], "source_id long, target_id long, kind string, invalid_at timestamp")
    made = G.document_cards(docs.select("id"), docs, chunks, entities, mentions, links)
    assert made["document"].first().chunks == 2
    assert made["entities"].first().name == "Ann"
    assert made["related"].count() == 0


def test_link_resolution(spark):
    docs = spark.createDataFrame(
        [(1, "Отпуск", "a/1"), (2, "отпуск", "a/2"), (3, "Other", "a/3")], "id long, title string, source_path string"
    )
    links = spark.createDataFrame(
        [(3, "ОТПУСК"), (3, "a/2"), (3, "Other"), (1, "nowhere"), (3, "A/2")], "source_id long, name string"
    )
    resolved, pending = K.resolve_links(links, docs)
    assert {tuple(r) for r in resolved.collect()} == {(3, 1), (3, 2)}
    assert {tuple(r) for r in pending.collect()} == {(1, "nowhere"), (3, "A/2")}
    waiting = spark.createDataFrame(
        [(9, "OTHER", "reference"), (3, "other", "reference"), (9, "x", "reference")], "source_id long, target_name string, kind string"
    )
    created, rest = K.resolve_pending(waiting, docs.filter("id = 3"))
    assert [tuple(r) for r in created.collect()] == [(9, 3, "reference")]
    assert [tuple(r) for r in rest.collect()] == [(9, "x", "reference")]


def test_relation_ends_within_one_document(spark):
    entities = spark.createDataFrame(
        [(1, "person", "ann"), (2, "product", "ann"), (3, "person", "bob")], "id long, entity_type string, canonical string"
    )
    mentioned = spark.createDataFrame(
        [(7, 0, "person", "Ann"), (7, 1, "product", " ANN "), (7, 2, "person", "Bob"), (8, 0, "person", "Ann")],
        "document_id long, pos int, entity_type string, name string",
    )
    relations = spark.createDataFrame(
        [(7, "ann", "bob", "owns"), (8, "ann", "bob", "owns")], "document_id long, source string, target string, relation string"
    )
    got = [tuple(r) for r in K.resolve_relations(relations, mentioned, entities).collect()]
    assert got == [(7, 2, 3, "owns")]


ENTITY = "id long, entity_type string, name string, canonical string, attributes string"


def test_frequent_runs_do_not_multiply_names(spark, monkeypatch):
    """Numbers share their trigrams, so each name met most entities before the smallest id was taken."""
    met, candidates = [], G.candidates

    def counted(*args):
        met.append(candidates(*args))
        return met[-1]

    monkeypatch.setattr(G, "candidates", counted)
    rows = [(i, "t", f"part {i % 10}{111_111 + i}", f"part {i % 10}{111_111 + i}", "{}") for i in range(300)]
    names = spark.createDataFrame([(str(111_111 + i),) for i in range(300)], "name string")
    found = {r.name: r.entity_id for r in G.find_entities(names, spark.createDataFrame(rows, ENTITY)).collect()}
    assert found == {str(111_111 + i): i for i in range(300)}
    assert sum(frame.count() for frame in met) == 0


def test_long_names_are_found(spark):
    words = ["".join(random.Random(n).choice("ab ") for _ in range(60)) + str(n) for n in range(30)]
    rows = [(i, "t", w.upper(), w.strip(), "{}") for i, w in enumerate(words + words)]
    asked = [w[1 : 1 + n] for w in words[:10] for n in (31, 32, 33, 50, 60)] + ["a" * 40]
    found = G.find_entities(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(rows, ENTITY))
    got = {r.name: r.entity_id for r in found.collect()}
    for name in asked:
        assert got.get(name) == min((i for i, _, w, *_ in rows if name in w.lower()), default=None), name


def test_cards_without_a_walk(spark, monkeypatch):
    monkeypatch.setattr(G, "neighbors", None)
    entities = spark.createDataFrame([(1, "person", "Ann", "ann", "{}")], ENTITY)
    names = spark.createDataFrame([("ann",)], "name string")
    assert [r.entity_id for r in G.entity_cards(names, entities, None, None, None, parts=["entity"])["entity"].collect()] == [1]


def test_edges_need_known_ends_and_come_once(spark):
    entities = spark.createDataFrame([(1, "person", "a"), (2, "person", "b"), (2, "person", "b again")], "id long, entity_type string, name string")
    roots = spark.createDataFrame([(1,)], "root long")
    _, lines = G.neighbors(roots, entities, edges(spark, [(1, 2), (1, 3), (3, 2)]), 2)
    assert [(r.source, r.target) for r in lines.collect()] == [(1, 2)]


def test_relations_are_read_once(spark):
    entities = spark.createDataFrame([(1, "person", "a"), (2, "person", "b")], "id long, entity_type string, name string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = edges(spark, [(1, 2)] * 5)
    _, lines = G.neighbors(spark.createDataFrame([(1,)], "root long"), entities, table.mapInArrow(counted, table.schema), 1)
    assert lines.count() == 5
    assert read.value == 5
