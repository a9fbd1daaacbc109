"""The dataset manifest against a tree built in one process, and the log's positions against a plain walk."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    """All levels of a tree, the ground first."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest("".join(rows[-1][k : k + 8])) for k in range(0, len(rows[-1]), 8)])
    return rows


def siblings(rows, at):
    found = []
    for row in rows[:-1]:
        first = at - at % 8
        found.append(("".join(row[first:at]), "".join(row[at + 1 : first + 8])))
        at //= 8
    return found


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = {}
    for doc_id, source, lang, n_chars, text in rows:
        own = digest("".join(map(field, (doc_id, source, lang, n_chars, text))))
        changed = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            changed = digest("".join(map(field, (doc_id, source, lang, n_chars, text.translate(small)))))
        leaves.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, changed))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([x[2] for x in sorted(leaves[lang])]) for lang in langs}
    top = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for at, (_, doc_id, own, changed) in enumerate(sorted(leaves[lang])):
            path = siblings(trees[lang], at) + siblings(top, number)
            node = changed
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 73, 511, 512, 513, 600])
def test_positions_are_the_order_of_completion(n):
    levels = merkle.height(n)
    order = []

    def walk(level, k):
        for child in range(8 * k, min(8 * k + 8, -(-n // 8 ** (level - 1)))) if level else ():
            walk(level - 1, child)
        order.append((level, k))

    walk(levels, 0)
    assert len(order) == merkle.log_size(n, levels)
    for level in range(levels + 1):
        count = -(-n // 8**level)
        found = merkle.positions(n, level, np.arange(count), levels).tolist()
        assert [order[p] for p in found] == [(level, k) for k in range(count)]


def test_a_lone_last_block_is_hashed_up_to_its_level():
    ground = [digest(str(k)) for k in range(3)]
    data, last = merkle._log(ground, 3)
    assert last == digest(digest(digest("".join(ground)))) and len(data) == 6 * 32


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, place int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA).repartition(5)


def found(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def awkward(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "en", "en", None, "", "Zz", "é", "de"])
        text = rng.choice([None, "", "Ünï A", f"text {k}", "Long " * rng.randint(1, 4000)])
        rows.append((rng.choice([k, k, k, 5, None]), rng.choice([None, "s"]), lang, rng.choice([None, k]), text))
    return rows + rows[:40]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_one_process(spark, levels):
    rows = awkward(levels, 700)
    assert found(merkle.manifest_digest(table(spark, rows), levels)) == expected(rows)


@pytest.mark.parametrize("n", [1, 8, 65])
def test_few_rows_of_one_language(spark, n):
    rows = [(k, "s", "en", 1, f"T{k}") for k in range(n)]
    assert found(merkle.manifest_digest(table(spark, rows), 1)) == expected(rows)


def test_equal_rows_and_empty_tables(spark):
    rows = [(1, "s", "en", 1, "same")] * 300
    assert found(merkle.manifest_digest(table(spark, rows), 1)) == expected(rows)
    assert merkle.manifest_digest(table(spark, rows).limit(0)).count() == 0


def test_single_proofs_are_sought_in_the_log(spark):
    rows = [(k, "s", ["de", "en"][k % 2], 1, f"T{k}") for k in range(300)]
    folder, leaves, trees = merkle.write_manifest(table(spark, rows), levels=2)
    reader = merkle.LogReader(folder, 2)
    of = {r.tree: r for r in trees.collect()}
    for row in leaves.where(F.col("doc_id") % 17 == 0).collect():
        tree = of[row.tree]
        path = reader.siblings(row.tree, row.place, row.n)
        assert merkle.fold(row.leaf, path) == tree.subroot
        assert merkle.fold(row.leaf, path + reader.siblings(merkle.TOP, tree.top_place, tree.n_trees)) == tree.root
        assert merkle.fold(digest("other"), path) != tree.subroot
