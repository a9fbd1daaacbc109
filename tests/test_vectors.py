"""Embeddings and nearest neighbours against numpy."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import embedding as E
from lorehouse.operators import vector_search as V
from lorehouse.operators.topics import assign_topics


def hashed(text, dim):
    vector = np.zeros(dim)
    for token in re.findall(r"\w+", text.lower()):
        vector[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = np.linalg.norm(vector)
    return vector / norm if norm else vector


def test_hashing_vectors(spark):
    texts = ["Привет, мир! Мир", "", "a b a", "ünï_1 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.embedding for r in E.embed(rows, "text", dim=32).collect()}
    for i, text in enumerate(texts):
        assert np.allclose(got[i], hashed(text, 32), atol=1e-6)
    query = E.embed(rows, "text", dim=32, is_query=True).filter("id = 2").first().embedding
    assert np.allclose(query, hashed(E.fixed.QUERY_PREFIX + "a b a", 32), atol=1e-6)


def test_words_are_hashed_once_per_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(E.hashlib, "md5", lambda word, real=E.hashlib.md5, **options: calls.append(word) or real(word, **options))
    tokens = pa.array(["a", "b", "a", "a", "b"])
    first = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 1000 for w in tokens.to_pylist()]
    del calls[:]
    assert E.token_buckets(tokens, 1000).tolist() == first and calls == [b"a", b"b"]
    assert E.token_buckets(tokens[:0], 1000).tolist() == []


def test_custom_model_is_called_in_batches(spark):
    def factory():
        def model(texts):
            assert len(texts) <= 2
            return np.array([[len(t), 1.0] for t in texts])

        return model

    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "text string").coalesce(1)
    got = [r.embedding for r in E.embed(rows, "text", factory=factory, batch=2).collect()]
    assert got == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]


def test_truncate(spark):
    rows = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 5.0],)], "v array<float>")
    got = [r.v for r in rows.select(E.truncate_and_renormalize(F.col("v"), 2).alias("v")).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0.0, 0.0]])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((300, 16)).astype(np.float32)
    matrix[100:180] = matrix[100]  # one hot group of copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)
    unit = matrix.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return frame, unit


def expected_top(unit, k):
    scores = (unit @ unit.T).round(V.SCORE_DIGITS)
    return {(q, int(i)) for q in range(len(unit)) for i in np.lexsort((np.arange(len(unit)), -scores[q]))[:k]}


@pytest.mark.parametrize("bound", [V.BROADCAST_BYTES, 0])
def test_exact_search_matches_brute_force(vectors, bound, monkeypatch):
    frame, unit = vectors
    monkeypatch.setattr(V, "CELL_BYTES", 16 * 8 * 40)  # many small cells
    queries = frame.withColumnRenamed("item_id", "query_id")
    got = V.cosine_top_k(queries, frame, 7, broadcast_bytes=bound).collect()
    assert {(r.query_id, r.item_id) for r in got} == expected_top(unit, 7)


def test_approximate_search(vectors, monkeypatch):
    frame, unit = vectors
    monkeypatch.setattr(V, "CELL_BYTES", 16 * 8 * 40)
    queries = frame.withColumnRenamed("item_id", "query_id")
    exact = V.cosine_top_k(queries, frame, 5)
    near = V.lsh_top_k(queries, frame, 5, bits=3, tables=10)
    assert V.recall_against(near, exact).first().recall > 0.9
    for row in near.collect():
        assert row.score == pytest.approx(unit[row.query_id] @ unit[row.item_id], abs=1e-6)


def test_dimension_guard(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    report = {r.stored_dim: r.matches for r in V.dimension_report(rows, 2).collect()}
    assert report == {1: False, 2: True}
    assert V.require_dimension(rows.filter(F.size("embedding") == 2), 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        V.require_dimension(rows, 2).collect()


def test_topics(spark):
    facts = spark.createDataFrame(
        [("ceny", "цены на пакеты обслуживания"), ("aaa", "цены на пакеты обслуживания")],
        "topic string, content string",
    )
    news = spark.createDataFrame(
        [(1, "цены на пакеты обслуживания выросли"), (2, "Расписание занятий на лето")],
        "content_id long, content string",
    )
    got = {r.content_id: r.topic for r in assign_topics(news, facts).collect()}
    assert got == {1: "aaa", 2: "расписание-занятий-лето"}
    empty = facts.limit(0)
    got = {r.content_id: r.topic for r in assign_topics(news, empty).collect()}
    assert got[2] == "расписание-занятий-лето"
