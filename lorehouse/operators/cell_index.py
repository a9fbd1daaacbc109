"""A stored approximate vector index: trained cells, residual codes, probes that know the filter.

Centroids are trained by k-means on a bounded sample; their number grows with the
square root of the rows. Every vector is stored in the cell of its nearest centroid as
the difference to it, one signed byte a dimension and a scale. A query looks into its
nearest cells until these hold enough vectors that pass the filter, so a narrow filter
widens the search instead of emptying it. How many cells that takes depends on the vectors
and the filter: it is measured on the exact neighbours of some of the queries. Codes give the best ``RESCORE`` * k items of a
query, whose own vectors, stored beside the codes, then give exact scores.

Queries go by the thousand, those of near cells together, and a task reads the cells that its queries look into
from the files of the index. Neither a query nor an item is copied for a cell, so neither memory nor disk grows with the number of cells looked into.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorehouse.functions.embedding import to_matrix, unit_rows
from lorehouse.operators.vector_search import PAIRS_AT_ONCE, SCORE_DIGITS, cosine_top_k
from lorehouse.session import cut_lineage, fresh_path

#: Rows the centroids are trained on, centroids at most, and rounds of training.
SAMPLE, MAX_CELLS, ROUNDS = 1 << 16, 1 << 14, 8
#: Cells a query looks into at least, and vectors these must hold, as a multiple of k.
PROBES, ENOUGH = 16, 64
#: Queries that the number of cells is measured on, and the share of their exact neighbours that these cells must hold.
MEASURED, HELD = 128, 0.96
#: Items scored exactly, as a multiple of k; queries that are taken together, and items read at once.
RESCORE, GROUP_ROWS = 8, 8192
#: Numbers of one array at most, and how far below its last cell's a similarity may lie (single precision).
AT_ONCE, SLACK = PAIRS_AT_ONCE // 4, 1e-6


def train(items: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centroids of (item_id, embedding); the sample is chosen by hash, so it is the same every time.

    Vectors of length zero are not trained on. Without any other there is one
    centroid of zeros.
    """
    counted = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    cells = cells or min(MAX_CELLS, max(1, math.ceil(math.sqrt(counted["n"]))))
    share = min(1.0, SAMPLE / max(1, counted["n"]))
    chosen = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)
    vectors = cut_lineage(items.filter(chosen & F.exists("embedding", lambda x: x != 0)).select("embedding"), "sample")
    if not vectors.take(1):
        return np.zeros((1, counted["dim"] or 1), np.float32)
    means = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=seed, featuresCol="features")
    model = means.fit(vectors.select(array_to_vector("embedding").alias("features")))
    return unit_rows(np.array(model.clusterCenters(), np.float32))


class CellIndex:
    """An index in a folder: ``centroids``, and ``items`` (cell, item_id, scale, code, embedding) sorted by cell.

    Workers read the items themselves: the folder is a mounted one, or one that Arrow's file systems know.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").toArrow()
        #: At most ``MAX_CELLS`` rows.
        self.centroids = to_matrix(rows["center"].combine_chunks())
        self.items = spark.read.parquet(f"{self.folder}/items")


def write_index(items: DataFrame, folder: str, cells: int | None = None) -> CellIndex:
    """Train, code and store (item_id, embedding); null vectors are left out."""
    spark = items.sparkSession
    items = items.select("item_id", "embedding").filter("embedding IS NOT NULL")
    centroids = train(items, cells)
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, center array<float>").coalesce(1).write.parquet(f"{folder}/centroids")
    held = spark.sparkContext.broadcast(centroids)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = held.value
        step = max(1, PAIRS_AT_ONCE // len(centers))
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(to_matrix(batch.column("embedding")))
            cell = np.concatenate([(unit[i : i + step] @ centers.T).argmax(1) for i in range(0, len(unit), step)])
            rest = unit - centers[cell]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.record_batch(
                [pa.array(cell.astype(np.int32)), batch.column("item_id"), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding")],
                names=["cell", "item_id", "scale", "code", "embedding"],
            )

    kinds = T.StructType(
        [T.StructField("cell", T.IntegerType()), items.schema["item_id"], T.StructField("scale", T.FloatType()), T.StructField("code", T.BinaryType()), items.schema["embedding"]]
    )
    _by_cell(items.mapInArrow(code, kinds)).write.parquet(f"{folder}/items")
    return CellIndex(spark, folder)


def _by_cell(coded: DataFrame) -> DataFrame:
    return coded.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id")


def _probed(queries: DataFrame, index: CellIndex, sizes: np.ndarray, probes: int, enough: int) -> DataFrame:
    """(query_id, embedding, cell, least): the nearest cell of each query, and the similarity of the last one it looks into.

    These are ``probes`` cells that are not empty, or as many as hold ``enough`` vectors.
    """
    held = index.spark.sparkContext.broadcast((index.centroids, sizes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, counts = held.value
        step = max(1, AT_ONCE // len(centers))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            if not counts.any():
                continue
            near = unit_rows(to_matrix(batch.column("embedding"))) @ centers.T
            near[:, counts == 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            inside = counts[order]
            before = np.cumsum(inside, axis=1) - inside
            place = np.arange(order.shape[1])[None, :]
            last = (((place < probes) | (before < enough)) & (inside > 0)).sum(1) - 1
            least = np.take_along_axis(near, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]
            yield pa.record_batch(
                [batch.column("query_id"), batch.column("embedding"), pa.array(order[:, 0].astype(np.int32)), pa.array(least.astype(np.float32))],
                names=["query_id", "embedding", "cell", "least"],
            )

    kinds = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("least", T.FloatType())])
    return queries.mapInArrow(probe, kinds)


def _needed(queries: DataFrame, index: CellIndex, inside: DataFrame, sizes: np.ndarray, k: int) -> int:
    """The number of nearest cells that hold ``HELD`` of the exact ``k`` neighbours of ``MEASURED`` queries, chosen by hash.

    One scan of the items; at most ``MEASURED`` * k pairs reach the driver.
    """
    some = cut_lineage(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED), "measured")
    exact = cosine_top_k(some, inside.select("item_id", "embedding"), k).select("query_id", "item_id")
    pairs = inside.select("item_id", "cell").join(F.broadcast(exact), "item_id").collect()
    if not pairs:
        return PROBES
    asked = some.toArrow()
    near = unit_rows(to_matrix(asked["embedding"].combine_chunks())) @ index.centroids.T
    near[:, sizes == 0] = -np.inf
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    row = {q: n for n, q in enumerate(asked["query_id"].to_pylist())}
    places = np.sort([place[row[r["query_id"]], r["cell"]] for r in pairs])
    return max(PROBES, int(places[math.ceil(HELD * len(places)) - 1]) + 1)


def _best(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``keep`` best of every row; of equal ones the first."""
    keep = min(keep, scores.shape[1])
    last = np.partition(scores, scores.shape[1] - keep, axis=1)[:, -keep, None]
    above, even = scores > last, scores == last
    missing = keep - above.sum(1, dtype=np.int32)
    chosen = above | (even & (even.cumsum(1, dtype=np.int32) <= missing[:, None]))
    rows, at = np.nonzero(chosen)
    return rows, at, scores[rows, at]


def _stored(path: str, columns: list[str], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of some cells, in the order of the files."""
    fs, root = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
    if files:
        chosen = pc.field("cell").isin(pa.array(cells.astype(np.int32)))
        rows = ds.dataset(files, filesystem=fs, format="parquet")
        for batch in rows.to_batches(columns=columns, filter=chosen, batch_size=GROUP_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if batch.num_rows:
                yield batch


class _Nearest:
    """The best ``keep`` items of each of some queries, by number; of equal scores the first numbers."""

    def __init__(self, queries: int, keep: int) -> None:
        self.keep, self.waiting = keep, 0
        #: What an item must exceed to be among the best of a query.
        self.least = np.full(queries, -np.inf, np.float32)
        self.parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32))]

    def add(self, rows: np.ndarray, first: int, scores: np.ndarray) -> None:
        """``scores`` of some queries with the items from number ``first`` on."""
        better = scores > self.least[rows, None]
        if np.count_nonzero(better) > len(rows) * self.keep:
            at, item, score = _best(scores, self.keep)
            chosen = score > self.least[rows[at]]
            at, item, score = at[chosen], item[chosen], score[chosen]
        else:
            at, item = np.nonzero(better)
            score = scores[at, item]
        self.parts.append((rows[at].astype(np.int32), item + first, score))
        self.waiting += len(at)
        if self.waiting > AT_ONCE:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number, score), sorted by query."""
        query, item, score = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.keep - 1
        self.least[query[full]] = score[full]
        kept = place < self.keep
        self.parts, self.waiting = [(query[kept], item[kept], score[kept])], 0
        return self.parts[0]


def _near(unit: np.ndarray, least: np.ndarray, path: str, centers: np.ndarray, cells: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item): numbers of the best ``keep`` items by code in the cells each query looks into."""
    found, first = _Nearest(len(unit), keep), 0
    for batch in _stored(path, ["cell", "scale", "code"], cells):
        cell = batch.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
        scale = batch.column("scale").to_numpy()
        starts = [0, *(np.nonzero(np.diff(cell))[0] + 1).tolist(), len(cell)]
        for a, b in zip(starts, starts[1:], strict=False):
            near = unit @ centers[cell[a]]
            rows = np.nonzero(near >= least)[0]
            rest = codes[a:b].astype(np.float32) * scale[a:b, None]
            step = max(1, AT_ONCE // (b - a))
            for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                found.add(some, first + a, unit[some] @ rest.T + near[some, None])
        first += len(cell)
    return found.best()[:2]


def _searched(queries: pa.RecordBatch, path: str, centers: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, item_id, score): the best ``k`` of each query, and those with the k-th score."""
    whole = unit_rows(to_matrix(queries.column("embedding"), np.float64))
    unit, least = unit_rows(to_matrix(queries.column("embedding"))), queries.column("least").to_numpy() - SLACK
    step = max(1, AT_ONCE // len(unit))
    cells = np.concatenate([i + np.nonzero((unit @ centers[i : i + step].T >= least[:, None]).any(0))[0] for i in range(0, len(centers), step)])
    query, item = _near(unit, least, path, centers, cells, RESCORE * k)
    order = np.argsort(item, kind="stable")
    query, item = query[order], item[order]
    scores, names, first, done = [], [], 0, 0
    for batch in _stored(path, ["item_id", "embedding"], cells):
        to = np.searchsorted(item, first + batch.num_rows)
        at = item[done:to] - first
        # each vector once
        which, back = np.unique(at, return_inverse=True)
        taken = batch.take(pa.array(which))
        other = unit_rows(to_matrix(taken.column("embedding"), np.float64))
        pairs = max(1, AT_ONCE // max(1, whole.shape[1]))
        for i in range(0, len(at), pairs):
            scores.append(np.einsum("ij,ij->i", whole[query[done + i : min(to, done + i + pairs)]], other[back[i : i + pairs]]).round(SCORE_DIGITS))
        names.append(taken.column("item_id").take(pa.array(back)))
        first, done = first + batch.num_rows, to
    if not done:
        return
    score = np.concatenate(scores)
    best = np.lexsort((-score, query))
    place = np.arange(done) - np.searchsorted(query[best], query[best])
    kth = np.full(len(unit), -np.inf)
    kth[query[best[place == k - 1]]] = score[best[place == k - 1]]
    kept = pa.array(np.nonzero(score >= kth[query])[0])
    columns = [queries.column("query_id").take(pa.array(query)).take(kept), pa.concat_arrays(names).take(kept), pa.array(score).take(kept)]
    yield pa.record_batch(columns, names=["query_id", "item_id", "score"])


def _first(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_cells(queries: DataFrame, index: CellIndex, items: DataFrame, k: int, *, within: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of about the ``k`` nearest items, with exact scores.

    ``probes``: cells that every query looks into, measured if it is not given.

    ``items``: item_id, embedding as indexed. ``within``: item_id of those that
    pass a filter; only these are looked at, and cells are counted by them. Equal
    scores go by item id. An empty index or filter finds nothing.
    """
    spark = index.spark
    queries = queries.select("query_id", "embedding").filter("query_id IS NOT NULL AND embedding IS NOT NULL")
    inside, path = index.items, f"{index.folder}/items"
    if within is not None:
        path = fresh_path(spark, "within")
        _by_cell(inside.join(within.select("item_id"), "item_id", "left_semi").select(*inside.columns)).write.parquet(path)
        inside = spark.read.schema(inside.schema).parquet(path)
    sizes = np.zeros(len(index.centroids), np.int64)
    for cell, n in inside.groupBy("cell").count().collect():
        sizes[cell] = n
    if probes is None:
        few = np.count_nonzero(sizes) <= PROBES
        probes = PROBES if few else _needed(queries, index, inside, sizes, k)
    probed = cut_lineage(_probed(queries, index, sizes, probes, ENOUGH * k), "probed")
    asked = probed.count()
    tasks = max(math.ceil(asked / GROUP_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(asked / PROBES)), 1)
    held = spark.sparkContext.broadcast(index.centroids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, GROUP_ROWS) for b in batches for i in range(0, b.num_rows, GROUP_ROWS)):
            yield from _searched(batch, path, held.value, k)

    kinds = T.StructType([queries.schema["query_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())])
    return _first(probed.repartitionByRange(tasks, "cell", "query_id").mapInArrow(search, kinds), k)
