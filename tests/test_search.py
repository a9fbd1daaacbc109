"""Full-text and hybrid search, and document filters."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lorehouse.functions.embedding import embed
from lorehouse.functions.jsonb import contains
from lorehouse.operators import filters, lexical
from lorehouse.operators.chunking import chunk_documents
from lorehouse.operators.evaluation import passage_holders
from lorehouse.operators.filters import document_predicate
from lorehouse.operators.hybrid import reciprocal_rank_fusion, search_chunks


def matches(spark, texts, queries, **options):
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    found = lexical.match(asked, lexical.token_table(chunks, options.get("analyzer")), options.get("analyzer"))
    out = {i: set() for i in range(len(queries))}
    for row in found.collect():
        out[row.query_id].add(row.chunk_id)
    return [out[i] for i in range(len(queries))]


TEXTS = ["Красная лиса бежит", "лиса спит, красная земля", "синяя птица", "код XK-42-Z найден", ""]


def test_websearch_syntax(spark):
    queries = [
        "лиса красная",
        '"красная лиса"',
        "птица or земля",
        "лиса -спит",
        'лиса -"красная лиса"',
        "-лиса",
        "XK-42-Z",
        "нет такого слова",
        "",
        "or лиса or",
    ]
    assert matches(spark, TEXTS, queries) == [
        {0, 1}, {0}, {1, 2}, {0}, {1}, {2, 3, 4}, {3}, set(), set(), {0, 1},
    ]


def test_stop_words_keep_positions(spark):
    analyzer = lexical.plain_words(("the", "of"))
    texts = ["king of the hill", "king hill", "the"]
    queries = ['"king of the hill"', "the king", "of"]
    assert matches(spark, texts, queries, analyzer=analyzer) == [{0}, {0, 1}, set()]


def model_rank(tokens, clauses):
    """Sum over minimal spans, by trying every span."""
    terms = {t for c in clauses for t in c}
    hits = [i for i, t in enumerate(tokens) if t in terms]

    def ok(a, b):
        inside = {tokens[i] for i in hits if a <= i <= b}
        return any(set(c) <= inside for c in clauses)

    spans = [(a, b) for a in hits for b in hits if a <= b and ok(a, b)]
    minimal = [
        s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)
    ]
    return sum(0.1 / (1 + (b - a) - (sum(a <= i <= b for i in hits) - 1)) for a, b in minimal)


def test_cover_density_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        tokens = [rng.choice("abcdef") for _ in range(rng.randint(1, 25))]
        clauses = [
            rng.sample("abcd", rng.randint(1, 3)) for _ in range(rng.randint(1, 2))
        ]
        rows.append((i, " ".join(tokens), clauses))
    terms = [sorted({t for c in clauses for t in c}) for _, _, clauses in rows]
    frame = spark.createDataFrame(
        [
            (i, text.split(), t, [[t.index(w) for w in c] for c in clauses])
            for (i, text, clauses), t in zip(rows, terms)
        ],
        "i long, tokens array<string>, terms array<string>, clauses array<array<int>>",
    )
    score = lexical.cover_density(F.col("tokens"), F.col("terms"), F.col("clauses"))
    got = {r.i: r.s for r in frame.select("i", score.alias("s")).collect()}
    for i, text, clauses in rows:
        assert got[i] == pytest.approx(model_rank(text.split(), clauses)), (text, clauses)


def test_single_words_are_counted(spark):
    # the long clause has words that do not occur; what stands between the others is no noise
    rows = [(["a", "x", "b", "a", "y"], ["a", "b", "c", "d"], [[0], [1, 2, 3]], 0.2), (["x"], ["a"], [[0]], 0.0),
            (["a", "x", "b", "a"], ["a", "b", "c"], [[0, 1], [2]], 0.15)]
    frame = spark.createDataFrame(rows, "tokens array<string>, terms array<string>, clauses array<array<int>>, want double")
    score = lexical.cover_density(F.col("tokens"), F.col("terms"), F.col("clauses"))
    for row in frame.select("want", score.alias("got")).collect():
        assert row.got == pytest.approx(row.want)


def test_passage_holders(spark):
    texts = ["one two three four", "xone two three fourx", "One two three four", "two three", "a\u03a3 b", None, "", "-two - three one two -three four",
             "one two\nthree four"]
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, raw_content string").withColumns(
        {"doc_type": F.lit("generic"), "attributes": F.lit("{}")})
    passages = ["one two three four", "two", "", None, "one two -three four", "two\nthree", "a\u03a3 b", "none of these"]
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")
    chunks = lexical.with_tokens(chunk_documents(documents))
    got = {(r.query_id, r.id) for r in passage_holders(asked, documents, chunks).collect()}
    assert got == {(q, d) for q, p in enumerate(passages) for d, text in enumerate(texts) if None not in (p, text) and p in text}


def test_rrf(spark):
    rows = [("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1), ("q", 1, "c", 2)]
    frame = spark.createDataFrame(rows, "query_id string, list int, item_id string, rank int")
    got = {r.item_id: r.score for r in reciprocal_rank_fusion(frame).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


@pytest.fixture(scope="module")
def knowledge(spark):
    documents = spark.createDataFrame(
        [
            (1, "Отпуска", "Правила отпуска сотрудников. Код ZX-991 в приложении.", "regulation", '{"status":"active","review_by":"2024-01-10","tags":["hr","hot"]}', datetime(2024, 1, 5)),
            (2, "Скидки 50%", "Скидка для клиентов компании и отпуска.", "generic", '{"status":"draft","review_by":"2025-02-01"}', datetime(2024, 2, 5)),
            (3, "Заметка", "Прочий текст про погоду.", "generic", "{}", datetime(2024, 3, 5)),
        ],
        "id long, title string, raw_content string, doc_type string, attributes string, created_at timestamp",
    ).withColumn("version", F.lit(1))
    chunks = embed(lexical.with_tokens(chunk_documents(documents)), "content", dim=64).withColumn(
        "chunk_id", F.col("document_id") * 1000 + F.col("chunk_index")
    )
    return documents, chunks


def test_hybrid_search(spark, knowledge):
    documents, chunks = knowledge
    queries = spark.createDataFrame([(1, "ZX-991"), (2, "отпуска")], "query_id long, query string")
    rows = search_chunks(queries, chunks, documents, dim=64).collect()
    first = {r.query_id: r for r in rows if r.place == 1}
    assert first[1].document == "Отпуска" and "ZX-991" in first[1].fragment
    only = filters.filter_documents(documents, {"doc_type": "generic", "title_contains": "скид"})
    rows = search_chunks(queries, chunks, documents, within=only, dim=64).collect()
    assert {r.document_id for r in rows} == {2}


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({}, {1, 2, 3}),
        ("not a dict", {1, 2, 3}),
        ({"doc_type": None, "unknown": 1}, {1, 2, 3}),
        ({"attributes": {"status": "active"}}, {1}),
        ({"attributes": {"tags": ["hot"]}}, {1}),
        ({"attributes": {}}, {1, 2, 3}),
        ({"title_contains": "0%"}, {2}),
        ({"title_contains": "_т"}, {1, 3}),
        ({"created_after": "2024-02-05"}, {3}),
        ({"created_before": "2024-02-05T10:00:00"}, {1}),
        ({"created_before": "junk"}, {1, 2, 3}),
        ({"review_by_before": "2024-06-01"}, {1}),
        ({"review_by_after": date(2024, 6, 1)}, {2}),
        ({"status_before": "2024-06-01"}, set()),
    ],
)
def test_document_filters(knowledge, wanted, ids):
    documents, _ = knowledge
    assert {r.id for r in filters.filter_documents(documents, wanted).collect()} == ids


def test_pages_and_entities(spark, knowledge):
    documents, _ = knowledge
    assert [r.id for r in filters.query_documents(documents, limit=2).collect()] == [3, 2]
    assert {r.total for r in filters.query_page(documents, limit=2).collect()} == {3}
    assert {r.total for r in filters.query_page(documents, limit=3).collect()} == {None}
    entities = spark.createDataFrame([(7, "иван"), (8, "мария")], "id long, canonical string")
    mentions = spark.createDataFrame(
        [(7, 1, "owner", None), (7, 2, "approver", datetime(2024, 1, 1)), (8, 3, None, None)],
        "entity_id long, document_id long, role string, invalid_at timestamp",
    )
    def ids(name, role=None):
        wanted = {"entity": {"name": name, "role": role}}
        return {r.id for r in filters.filter_documents(documents, wanted, mentions=mentions, entities=entities).collect()}

    assert ids(" Иван ") == {1}
    assert ids("иван", "owner") == {1}
    assert ids("иван", "approver") == set()
    assert ids("мария") == {3}


def test_containment_and_dates(spark):
    have = F.parse_json(F.lit('{"a":1,"b":["x",{"y":2}],"c":{"d":true,"e":null}}'))
    cases = [
        ({"a": 1.0}, True), ({"a": "1"}, False), ({"b": [{"y": 2}]}, True), ({"b": "x"}, False),
        ({"c": {"e": None}}, True), ({"zz": None}, False), ({"b": []}, True), ({"c": []}, False),
    ]
    row = spark.range(1).select(*[contains(have, w).alias(f"c{i}") for i, (w, _) in enumerate(cases)]).first()
    assert list(row) == [expected for _, expected in cases]
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 9)), (2, datetime(2024, 3, 1)), (3, None)], "id long, created_at timestamp")
    found = lambda bound: {r.id for r in rows.filter(document_predicate({"created_before": bound})).collect()}
    assert found("2024-01-02T03:04:05") == found(date(2024, 1, 2)) == found(datetime(2024, 1, 2, 5)) == {1}
    assert found(5) == found("2026-13-99") == found("soon") == {1, 2, 3}


def test_candidates_whitelist_idle(spark):
    documents = spark.createDataFrame(
        [(1, "done", "faq", "m1", "file"), (2, "done", "faq", None, "url"), (3, "failed", "faq", "m1", "url")],
        "id long, extraction_status string, doc_type string, extraction_model string, source_kind string",
    ).withColumn("source_path", F.concat(F.lit("p"), "id"))
    assert [r.id for r in filters.reextract_candidates(documents, not_model="m1").collect()] == [2]
    assert [r.id for r in filters.reextract_candidates(documents, status="done").collect()] == [1, 2]
    assert [r.source_path for r in filters.refresh_candidates(documents).collect()] == ["p2", "p3"]
    users = spark.createDataFrame([(10,)], "telegram_id long")
    events = spark.createDataFrame([(10, "a"), (11, "b")], "telegram_id long, text string")
    assert [r.text for r in filters.whitelist(events, users).collect()] == ["a"]
    assert [r.text for r in filters.strangers(events, users).collect()] == ["b"]
    sessions = spark.createDataFrame(
        [(1, True, datetime(2024, 1, 1, 11)), (2, True, datetime(2024, 1, 1, 10, 59)), (3, False, datetime(2020, 1, 1))],
        "id long, active boolean, last_active_at timestamp",
    )
    stale = filters.idle(sessions, F.lit(datetime(2024, 1, 1, 12)))
    assert [r.id for r in stale.collect()] == [2]
