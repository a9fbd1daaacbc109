"""The stored vector index against exact search, with filters, equal vectors and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.operators import cell_index as C
from lorehouse.operators.vector_search import cosine_top_k, recall_against

KINDS = "item_id bigint, embedding array<float>"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 24))
    rows = [(n, (centers[n % 30] + 0.4 * rng.normal(size=24)).tolist()) for n in range(3000)]
    rows += [(5000 + n, centers[0].tolist()) for n in range(400)] + [(9000, [0.0] * 24), (9001, None)]
    return spark.createDataFrame(rows, KINDS).repartition(4).persist()


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return C.write_index(items, str(tmp_path_factory.mktemp("cells") / "index"))


def queries_of(items):
    return items.filter("item_id % 20 = 0 AND item_id < 5000").select(F.col("item_id").alias("query_id"), "embedding")


def test_every_vector_is_in_one_cell(items, index):
    rows = index.items.collect()
    assert sorted(r.item_id for r in rows) == sorted(r.item_id for r in items.filter("embedding IS NOT NULL").collect())
    # equal vectors that are drawn as first centroids count once
    assert 30 <= len(index.centroids) <= 59 and {r.cell for r in rows} <= set(range(len(index.centroids)))
    vectors = {r.item_id: r.embedding for r in items.collect()}
    for r in rows[:200]:
        unit = np.array(vectors[r.item_id]) / max(1e-9, np.linalg.norm(vectors[r.item_id]))
        back = index.centroids[r.cell] + np.frombuffer(bytes(r.code), np.int8) * r.scale
        assert np.abs(back - unit).max() <= r.scale + 1e-6  # single precision


@pytest.mark.parametrize("step", [1, 3, 400])
def test_recall(monkeypatch, items, index, step):
    monkeypatch.setattr(C, "GROUP_ROWS", 64)
    pool = items.filter(F.col("item_id") % step == 0).filter("embedding IS NOT NULL")
    within = None if step == 1 else pool.select("item_id")
    found = C.search_cells(queries_of(items), index, items, 10, within=within, probes=6).persist()
    exact = cosine_top_k(queries_of(items), pool, 10)
    assert recall_against(found, exact).first()["recall"] >= 0.9
    assert found.join(pool, "item_id", "left_anti").count() == 0
    same = found.withColumnRenamed("score", "s").join(exact, ["query_id", "item_id"])
    assert same.filter("abs(s - score) > 1e-9").count() == 0


def test_all_cells_give_almost_the_exact_answer(items, index):
    found = C.search_cells(queries_of(items), index, items, 5, probes=len(index.centroids))
    exact = cosine_top_k(queries_of(items), items.filter("embedding IS NOT NULL"), 5)
    assert recall_against(found, exact).first()["recall"] >= 0.99


def test_nothing_inside(spark, items, index, tmp_path):
    queries = queries_of(items)
    assert C.search_cells(queries, index, items, 5, within=items.filter("item_id < 0").select("item_id")).count() == 0
    assert C.search_cells(queries.limit(0), index, items, 5).count() == 0
    empty = C.write_index(spark.createDataFrame([], KINDS), str(tmp_path / "none"))
    assert C.search_cells(queries.limit(0), empty, items, 5).count() == 0
    zeros = spark.createDataFrame([(1, [0.0] * 24), (2, [0.0] * 24)], KINDS)
    only = C.write_index(zeros, str(tmp_path / "zeros"))
    assert {r.score for r in C.search_cells(queries.limit(1), only, zeros, 5).collect()} == {0.0}


@pytest.mark.parametrize("step", [1, 5])
def test_recall_without_clusters(spark, tmp_path, step):
    """Vectors in all directions, whose neighbours are spread over many cells."""
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(n, rng.normal(size=64).tolist()) for n in range(2000)], KINDS).persist()
    index = C.write_index(items, str(tmp_path / "index"))
    pool = items.filter(F.col("item_id") % step == 0)
    queries = queries_of(items)
    found = C.search_cells(queries, index, items, 10, within=None if step == 1 else pool)
    assert recall_against(found, cosine_top_k(queries, pool, 10)).first()["recall"] >= 0.9


def test_a_query_is_not_copied_for_its_cells(items, index):
    sizes = np.zeros(len(index.centroids), np.int64)
    for cell, n in index.items.groupBy("cell").count().collect():
        sizes[cell] = n
    probed = C._probed(queries_of(items), index, sizes, len(sizes), 1).collect()
    assert sorted(r.query_id for r in probed) == sorted(r.query_id for r in queries_of(items).collect())


@pytest.mark.parametrize("at_once", [50, 1000])
def test_small_slices_find_the_same(monkeypatch, items, index, at_once):
    """Called here and not in a worker, which has constants of its own."""
    sizes = np.zeros(len(index.centroids), np.int64)
    for cell, n in index.items.groupBy("cell").count().collect():
        sizes[cell] = n
    asked = C._probed(queries_of(items), index, sizes, 9, 1).toArrow().combine_chunks().to_batches()[0]

    def found():
        return sorted(tuple(r.values()) for b in C._searched(asked, f"{index.folder}/items", index.centroids, 7) for r in b.to_pylist())

    want = found()
    assert len(want) >= 7 * asked.num_rows
    monkeypatch.setattr(C, "GROUP_ROWS", 32)
    monkeypatch.setattr(C, "AT_ONCE", at_once)
    assert found() == want


def test_nearest_keeps_the_first_of_equal_scores(monkeypatch):
    monkeypatch.setattr(C, "AT_ONCE", 40)
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, size=(5, 300)).astype(np.float32)
    nearest = C._Nearest(5, 8)
    for first in range(0, 300, 20):
        nearest.add(np.arange(5), first, scores[:, first : first + 20])
    query, item, _ = nearest.best()
    for n in range(5):
        assert item[query == n].tolist() == np.lexsort((np.arange(300), -scores[n]))[:8].tolist()
