"""Block postings: levels, sizes, and the early stop against the search that reads everything."""

import random

import pytest

from lorehouse.operators import block_postings as B
from lorehouse.operators.lexical import lexical_top_k, token_table


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    rows = [(n, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 60, 200])))) for n in range(1500)]
    rows += [(2000, ""), (2001, None), (2002, "solo"), (2003, "w0 " * 300), (2004, "w0 " * 300)]
    tokens = token_table(spark.createDataFrame(rows, "chunk_id bigint, content string")).persist()
    blocks = B.write_blocks(tokens, str(tmp_path_factory.mktemp("blocks") / "index"), 16)
    return tokens, blocks.persist()


def test_blocks_hold_every_posting_once(index):
    tokens, blocks = index
    counted = {}
    for row in tokens.collect():
        for word in row.tokens or []:
            counted[word, row.chunk_id] = counted.get((word, row.chunk_id), 0) + 1
    found = [(r.term, i.chunk_id, i.tf) for r in blocks.filter("term <> ''").collect() for i in r["items"]]
    assert len(found) == len(counted) and {(t, c): n for t, c, n in found} == counted
    for r in blocks.collect():
        assert r.n == len(r["items"]) and r.top == max(i.tf for i in r["items"])
        if r.term:
            assert {B_level(i.tf) for i in r["items"]} == {r.level}
    assert sum(r.n for r in blocks.filter("term = ''").collect()) == tokens.count()


def B_level(count):
    import math

    return count if count <= 8 else 8 + math.floor(math.log2(count / 8) * 4)


QUERIES = [
    (1, "w0"), (2, "w3 w1"), (3, "w0 or w1"), (4, "w0 w1 w2 or w30 or w5"), (5, '"w0 w1"'), (6, "w2 -w0"), (7, "-w0"), (8, "unknown"),
    (9, "w0 or unknown"), (10, ""), (11, '"w1 w0" w3 or w39 -w2'), (12, "solo"), (13, "w39"), (14, "-w0 or w7"), (15, "w0 w0"),
]


@pytest.mark.parametrize("k", [3, 20])
def test_the_best_are_the_same(spark, index, k):
    tokens, blocks = index
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query string")
    found, read = B.top_k_by_blocks(queries, blocks, tokens, k)
    want = lexical_top_k(queries, tokens, k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    shares = {r.query_id: (r.read, r.blocks) for r in read.collect()}
    assert all(0 < a <= b for a, b in shares.values())
    assert shares[1][0] <= 0.2 * shares[1][1] and shares[3][0] <= 0.2 * shares[3][1]


def test_within_some_chunks(spark, index):
    tokens, blocks = index
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query string")
    some = tokens.filter("chunk_id % 7 = 0").select("chunk_id")
    found = B.top_k_by_blocks(queries, blocks, tokens, 5, within=some)[0]
    want = lexical_top_k(queries, tokens.join(some, "chunk_id", "left_semi"), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_to_find(spark, index):
    tokens, blocks = index
    queries = spark.createDataFrame([(1, "unknown"), (2, "")], "query_id bigint, query string")
    found, read = B.top_k_by_blocks(queries, blocks, tokens)
    assert found.count() == 0 and found.columns == ["query_id", "chunk_id", "score", "rank"] and read.count() == 0


def test_blocks_are_made_once(spark):
    """Ranges over the made blocks had all of them made for a sample first, and exchanged twice."""
    from lorehouse.operators import block_postings as B

    tokens = spark.createDataFrame([(n, ["a", "b"] * (n % 5)) for n in range(50)], "chunk_id bigint, tokens array<string>")
    made = B._in_blocks(B._placed(tokens, 4).repartitionByRange("term", "level", "part"))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(term" in plan
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line and "part#" in line]
    assert not exchanges


def test_postings_meet_first_in_their_block(spark):
    """They were exchanged to be counted, and again to look up the number of blocks."""
    tokens = spark.createDataFrame([(n, ["a", "b", None, "a"] * (n % 5)) for n in range(50)] + [(60, None)], "chunk_id bigint, tokens array<string>")
    placed = B._placed(tokens, 4)
    rows = {(r.term, r.chunk_id): (r.tf, r.level, r.part) for r in placed.collect()}
    assert rows["a", 4][:2] == (8, 8) and rows["b", 1] == (1, 1, rows["b", 1][2]) and rows["", 60][0] == 0 and ("a", 60) not in rows
    assert len(rows) == 51 + 2 * 40
    assert "hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


def test_rounds_meet_the_asked_words_only(spark, monkeypatch):
    tokens = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c"]), (3, None)], "chunk_id bigint, tokens array<string>")
    clauses = B.parse_queries(spark.createDataFrame([(1, "a -c"), (2, "x")], "query_id bigint, query string"))
    kept = {r.chunk_id: r.tokens for r in B._asked_words(tokens, clauses).collect()}
    assert kept == {1: ["a", None, "c"], 2: ["c"], 3: None}
    monkeypatch.setattr(B, "WORDS", 2)
    assert {r.chunk_id: r.tokens for r in B._asked_words(tokens, clauses).collect()}[1] == ["a", "b", "c"]
