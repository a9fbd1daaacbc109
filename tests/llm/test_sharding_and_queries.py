"""Shards, and the registered queries on the smallest tables."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorehouse.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


def test_shards(documents, rows, nothing):
    found = sharding.shard_digest(documents, 4).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    places, sizes = defaultdict(list), Counter()
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < 4 and r.grown_shard is None
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_digest(nothing, 4).count() == 0


def test_shards_are_even(spark):
    frame = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text"))
    total = [r["sum(size)"] for r in sharding.shard_digest(frame, 40).groupBy("shard").sum("size").collect()]
    assert len(total) == 40 and max(total) - min(total) < 0.01 * max(total)


def test_the_map_keeps_versions_and_moves_little(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    _, versions = sharding.shard_documents(frame, 8, 512)
    assert [tuple(r) for r in versions.groupBy("version").count().orderBy("version").collect()] == [(0, 512), (1, 512)]
    now = versions.where("version = 1").persist()
    sizes = sharding.slot_sizes(sharding.records_of(frame, 512))
    grown = sharding.rebalanced(now, sizes, 9)
    moved = now.join(grown.withColumnRenamed("shard", "to"), "virtual_slot").where("shard <> to").count()
    assert grown.count() == 512 and grown.where("shard = 8").count() > 0 and moved < 512 / 4
    shrunk = sharding.rebalanced(now, sizes, 5)
    assert shrunk.count() == 512 and {r.shard for r in shrunk.select("shard").distinct().collect()} == set(range(5))


def test_a_stored_map_is_edited(spark, tmp_path):
    """A second run on grown data, and a third on more shards, start from the map that the run before left."""
    folder = str(tmp_path / "map")

    def run(n, shards):
        frame = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text"))
        placed, versions = sharding.shard_documents(frame, shards, 512, folder)
        sizes = Counter()
        for r in placed.collect():
            sizes[r.shard] += r.size
        assert len(sizes) == shards and max(sizes.values()) < 1.05 * min(sizes.values())
        maps = defaultdict(dict)
        for r in versions.collect():
            assert r.virtual_slot not in maps[r.version]
            maps[r.version][r.virtual_slot] = r.shard
        assert all(len(m) == 512 for m in maps.values())
        return maps

    first = run(6000, 8)
    second = run(9000, 8)
    third = run(9000, 9)
    assert sorted(first) == [0, 1] and sorted(second) == [0, 1, 2] and sorted(third) == [0, 1, 2, 3]
    assert third[1] == second[1] == first[1] and third[2] == second[2]
    moved = [sum(third[v][s] != third[v + 1][s] for s in range(512)) for v in range(3)]
    assert moved[1] < 512 / 4 and moved[2] < 512 / 4
    with pytest.raises(ValueError):
        sharding.shard_documents(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), 8, 256, folder)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_every_query_has_a_row_for_each_input(spark):
    documents, pages = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages"))
    made = queries.queries()
    assert set(queries.oracle_sql()) <= set(made) and len(made) == 14
    for name in ("op1_toxicity", "op2_token_files", "op4_fingerprint", "op7_suffix_dedup", "op8_near_duplicates", "op9_decontaminate", "op10_shard", "op12_byte_pairs", "op13_merkle"):
        assert made[name](spark, FOLDER).count() == documents, name
    assert made["op5_main_text"](spark, FOLDER).count() == pages
    assert made["op6_warc_derivatives"](spark, FOLDER).count() == 2 * pages


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, FOLDER).exceptAll(pieces).count() == 0
