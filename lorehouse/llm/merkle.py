"""Merkle manifest of a dataset: a postorder log of hash trees, and proofs read from it by position.

Every row is a leaf; leaves of one language, in order of doc_id, are the ground of
one tree, in which every 8 consecutive nodes (the last run may be shorter) become
their hash until one is left, the subroot. The subroots, in order of language, are
the ground of one more tree, whose last node is the root of the dataset.

A tree is logged in rounds of ``LEVELS`` levels. A builder takes an aligned block
of 8**LEVELS consecutive nodes and writes the nodes above them, and these
themselves, in the order in which they are completed: a node follows the last of
its children at once. That order is postorder, so the place of a node follows from
the sizes of the subtrees before it alone (``positions``), and a proof seeks the
siblings it needs in files whose names follow from their numbers. Blocks that are
full never change when later rows are appended. A builder's file is written under
a name of its own and renamed, so a task that runs twice leaves the same file.

Folder: ``<tree>/<round>/<block>.log`` with 32 bytes a node; a tree is named by the
SHA-256 of its language, ``null`` without one, and ``top`` above them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse.llm.blocks import bounded_batches, rows_of
from lorehouse.session import cut_lineage, fresh_path

FANOUT = 8
#: Levels of a builder: blocks of 4096 nodes, files of 150 kB.
LEVELS = 4
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"
#: Bytes of a digest in the log, and as hexadecimal text.
RAW, HEX = 32, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the ground of a tree with ``n`` nodes there."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def positions(n: int, level: int, nodes: np.ndarray, levels: int) -> np.ndarray:
    """Places in the log of nodes of one level, over ``n`` nodes of ground and up to ``levels`` levels.

    A full node is completed by the last node of its ground: before it stand all
    nodes that were complete one node of ground earlier, and its own descendants
    on that last path. Nodes over an incomplete run are written when the block
    is closed, from the lowest level up.
    """
    powers = FANOUT ** np.arange(levels + 1)
    last = (nodes.astype(np.int64) + 1) * powers[level] - 1
    full = (np.minimum(last, n)[:, None] // powers).sum(1) + level
    closing = int((n // powers).sum()) + int((n % powers[1 : max(level, 1)] != 0).sum())
    return np.where(last < n, full, closing)


def log_size(n: int, levels: int) -> int:
    """Nodes of a log."""
    return sum(-(-n // FANOUT**level) for level in range(levels + 1))


def _write(folder: str, tree: str, turn: int, block: int, data: bytes) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/{tree}/{turn}", recursive=True)
    own = f"{root}/{tree}/{turn}/.{block}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{root}/{tree}/{turn}/{block}.log")


def _log(ground: list[str], levels: int) -> tuple[bytes, str]:
    """The nodes over a block in the order of their completion, and the last of them."""
    n = len(ground)
    nodes = np.empty((log_size(n, levels), RAW), np.uint8)
    row = ground
    for level in range(levels + 1):
        places = positions(n, level, np.arange(len(row)), levels)
        nodes[places] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, RAW)
        if level < levels:
            row = [_hash("".join(row[k : k + FANOUT])) for k in range(0, len(row), FANOUT)]
    return nodes.tobytes(), row[0]


def _builder(folder: str, turn: int, levels: int):
    """Write the block's log and pass on its top node."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "tree", "block", "n", "digest")
        out: list[tuple] = []
        for (tree, block, n), group in groupby(rows, key=lambda r: r[:3]):
            ground = [r[3] for r in group]
            if len(ground) != min(FANOUT**levels, n - block * FANOUT**levels):
                raise RuntimeError(f"block {block} of tree {tree} came in parts")
            data, last = _log(ground, min(levels, height(n)))
            _write(folder, tree, turn, block, data)
            out.append((tree, block, -(-n // FANOUT**levels), last))
        names = ["tree", "place", "n", "digest"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_NODES)

    return build


_NODES = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_NODES_SQL = "tree string, place bigint, n bigint, digest string"


def _in_order(frame: DataFrame, levels: int) -> DataFrame:
    """Blocks as groups of sorted rows, each within one partition."""
    block = F.floor(F.col("place") / F.lit(FANOUT**levels)).cast("bigint")
    return frame.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def build_trees(ground: DataFrame, folder: str, levels: int = LEVELS) -> DataFrame:
    """Log the trees over ``ground`` (tree, place, n, digest) round by round; returns (tree, digest) of their last nodes.

    ``place`` counts a tree's nodes from 0 and ``n`` is their number. A round
    passes on one node of 8**levels, and a tree leaves when one node is left,
    so there are log(n) / log(8**levels) rounds, at least one.
    """
    last, turn = [], 0
    nodes = ground.select("tree", "place", "n", "digest")
    while True:
        made = _in_order(nodes, levels).mapInArrow(_builder(folder, turn, levels), _NODES_SQL)
        made = cut_lineage(made, "merkle-nodes")
        last.append(made.where("n = 1").select("tree", "digest"))
        nodes, turn = made.where("n > 1"), turn + 1
        if not nodes.take(1):
            break
    for more in last[1:]:
        last[0] = last[0].unionByName(more)
    return last[0]


def with_place(frame: DataFrame, tree: str, order: list[str | Column], nth: str) -> DataFrame:
    """Add ``place`` and ``n``: a row's number in its tree, from 0, and the rows of the tree.

    The rows are sorted over the cluster; ``nth`` is unique, so even equal rows
    are dealt to several tasks. Places are counted within a sorted part and
    moved by the rows of the parts before, one number per part and tree.
    """
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in [tree, *order, nth]]
    parts = frame.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = cut_lineage(parts, "merkle-sorted")
    sizes = parts.groupBy(tree, "_part").count()
    by_tree = Window.partitionBy(tree)
    before = by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(tree, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"), F.sum("count").over(by_tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*keys[1:])) - 1
    numbered = parts.withColumn("_inside", inside).join(bases, [tree, "_part"])
    return numbered.withColumn("place", (F.col("_base") + F.col("_inside")).cast("bigint")).drop("_part", "_base", "_inside", nth)


def _field(name: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a row's fields; ``changed`` replaces some of them."""
    return F.sha2(F.concat(*[_field(c, changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered_leaf() -> Column:
    """The hash of a row whose text has been set in small letters (A to Z only); null for rows that are left alone."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf(text=F.translate(F.col("text"), _UPPER, _LOWER)))


def write_manifest(documents: DataFrame, folder: str | None = None, levels: int = LEVELS, **more: Column) -> tuple[str, DataFrame, DataFrame]:
    """Log the trees of all rows; returns the folder, the leaves and the trees.

    Leaves: doc_id, lang, leaf, tree, place, n and the columns ``more``. Trees:
    tree, lang, subroot, its place in the top tree, the number of trees and the
    root. Rows with equal lang and doc_id (null first) are ordered by leaf;
    repeated rows are leaves of their own. An empty table has no tree and no
    root. Columns beside ``FIELDS`` are not read. ``folder`` must be seen by all
    executors: a mounted folder or a URI that Arrow's file systems know.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = folder or fresh_path(spark, "merkle")
    tree = F.coalesce(F.sha2(F.col("lang"), 256), F.lit("null"))
    made = {"leaf": leaf(), **more}
    leaves = documents.select("doc_id", "lang", tree.alias("tree"), *[c.alias(n) for n, c in made.items()], F.monotonically_increasing_id().alias("_nth"))
    leaves = cut_lineage(with_place(cut_lineage(leaves, "merkle-leaves"), "tree", ["doc_id", "leaf"], "_nth"), "merkle-placed")
    subroots = build_trees(leaves.withColumnRenamed("leaf", "digest"), folder, levels)
    langs = leaves.where("place = 0").select("tree", "lang")
    rows = subroots.withColumnRenamed("digest", "subroot").join(langs, "tree").withColumns({"_top": F.lit(TOP), "_nth": F.lit(0)})
    rows = with_place(rows, "_top", ["lang"], "_nth").withColumnsRenamed({"place": "top_place", "n": "n_trees"})
    rows = cut_lineage(rows, "merkle-subroots")
    top = build_trees(rows.select(F.col("_top").alias("tree"), F.col("top_place").alias("place"), F.col("n_trees").alias("n"), F.col("subroot").alias("digest")), folder, levels)
    trees = rows.join(top.withColumnsRenamed({"tree": "_top", "digest": "root"}), "_top").drop("_top")
    return folder, leaves, cut_lineage(trees, "merkle-trees")


class LogReader:
    """Nodes of a manifest's logs by their numbers."""

    def __init__(self, folder: str, levels: int = LEVELS) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.levels = levels

    def _path(self, tree: str, turn: int, block: int) -> str:
        return f"{self.root}/{tree}/{turn}/{block}.log"

    def siblings(self, tree: str, place: int, n: int, turn: int = 0) -> list[tuple[str, str]]:
        """(left siblings, right siblings) of a node, level by level up to the tree's last node, sought by position."""
        found = []
        while n > 1:
            block, at = divmod(place, FANOUT**self.levels)
            ground = min(FANOUT**self.levels, n - block * FANOUT**self.levels)
            up = min(self.levels, height(n))
            with self.fs.open_input_file(self._path(tree, turn, block)) as file:
                for level in range(up):
                    first = at - at % FANOUT
                    run = np.arange(first, min(first + FANOUT, -(-ground // FANOUT**level)))
                    places = positions(ground, level, run, up).tolist()
                    names = [file.read_at(RAW, RAW * p).hex() if k != at else "" for k, p in zip(run.tolist(), places, strict=True)]
                    found.append(("".join(names[: at - first]), "".join(names[at - first :])))
                    at //= FANOUT
            place, n, turn = block, -(-n // FANOUT**self.levels), turn + 1
        return found

    def block(self, tree: str, block: int, n: int) -> list[str]:
        """The levels of a block of the ground that have siblings, each as one text of digests in order."""
        ground = min(FANOUT**self.levels, n - block * FANOUT**self.levels)
        up = min(self.levels, height(n))
        with self.fs.open_input_file(self._path(tree, 0, block)) as file:
            nodes = np.frombuffer(file.read(), np.uint8).reshape(-1, RAW)
        if len(nodes) != log_size(ground, up):
            raise RuntimeError(f"block {block} of tree {tree} is not whole")
        counts = [-(-ground // FANOUT**level) for level in range(up)]
        return [nodes[positions(ground, level, np.arange(c), up)].tobytes().hex() for level, c in enumerate(counts)]


def fold(digest: str, siblings: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in siblings:
        digest = _hash(left + digest + right)
    return digest


def _prover(folder: str, levels: int):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LogReader(folder, levels)
        top = cache(lambda place, n: reader.siblings(TOP, place, n))

        seen, local, above = None, [], []
        for batch in batches:
            names = ("tree", "block", "n", "place", "leaf", "changed", "top_place", "n_trees")
            proofs, roots = [], []
            for tree, block, n, place, own, changed, top_place, n_trees in rows_of(iter([batch]), *names):
                if seen != (tree, block):
                    seen, local = (tree, block), reader.block(tree, block, n)
                    above = reader.siblings(tree, block, -(-n // FANOUT**levels), 1) + top(top_place, n_trees)
                at, path = place % FANOUT**levels, []
                for text in local:
                    first, k = HEX * (at - at % FANOUT), HEX * at
                    path.append((text[first:k], text[k + HEX : first + HEX * FANOUT]))
                    at //= FANOUT
                path += above
                proofs.append(_hash("".join([x for pair in path for x in pair])))
                roots.append(fold(changed or own, path))
            yield batch.append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(roots, pa.string()))

    return prove


def prove(folder: str, leaves: DataFrame, trees: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Add ``proof_sha256`` and ``folded_root`` to leaves with a column ``changed`` (a leaf to fold instead, or null).

    The proof of a leaf are its siblings level by level through the subroot to
    the root, left to right; ``folded_root`` is the root that follows from the
    leaf and these siblings. A task reads a block's log once and seeks the few
    nodes above it.
    """
    rows = _in_order(leaves.join(trees.drop("lang"), "tree"), levels)
    added = "proof_sha256 string, folded_root string"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_prover(folder, levels), f"{kinds}, {added}")


def manifest_digest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots, proof and the outcome of tampering with a third of the texts, per row.

    Rows whose doc_id is null are not tampered with; null texts stay null.
    """
    folder, leaves, trees = write_manifest(documents, levels=levels, changed=tampered_leaf())
    return prove(folder, leaves, trees, levels).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "lang",
        F.col("place").alias("leaf_place"),
    )
