"""Russian stems: published pairs of the algorithm, and search with them."""

import pytest
from pyspark.sql import functions as F

from lorehouse.functions.stemming import russian_stem
from lorehouse.operators.lexical import lexical_top_k, match, positions, postings, russian_words, term_counts, term_statistics, token_table

PAIRS = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагоне вагон вагонов вагон важная важн важнее важн важнейшие важн
важничал важнича важно важн важного важн важной важн важность важност важную важн важны важн вал вал валандался валанда
валериановых валерианов валерию валер валетами валет вали вал падаль падал падать пада падаю пада падающих пада падшая падш
палками палк пальто пальт регламенты регламент регламент регламент регламентами регламент сотрудников сотрудник сотрудники сотрудник
скидок скидок скидки скидк инструкция инструкц инструкции инструкц согласована согласова согласовавший согласова её е длинный длин
vpn vpn 2024 2024"""


def test_published_pairs(spark):
    words = PAIRS.split()
    pairs = list(zip(words[::2], words[1::2], strict=True))
    frame = spark.createDataFrame(pairs, "word string, stem string")
    wrong = frame.withColumn("found", russian_stem(F.col("word"))).filter("found <> stem").collect()
    assert not wrong


def test_null_and_empty(spark):
    frame = spark.createDataFrame([(None,), ("",)], "word string")
    assert [r[0] for r in frame.select(russian_stem(F.col("word"))).collect()] == [None, ""]


@pytest.mark.parametrize("asked", ["регламент", "регламенты", "Регламентов", '"согласования регламентов"', "и -скидка регламентом"])
def test_other_forms_are_found(spark, asked):
    chunks = spark.createDataFrame(
        [(1, "Согласование регламента"), (2, "Скидки по регламенту"), (3, "Отпуск и VPN"), (4, "о согласовании регламентов")],
        "chunk_id bigint, content string",
    )
    tokens = token_table(chunks, russian_words())
    queries = spark.createDataFrame([(1, asked)], "query_id bigint, query string")
    found = {r.chunk_id for r in match(queries, tokens, russian_words()).collect()}
    assert 1 in found and 3 not in found and 4 in found
    assert ("-" in asked or '"' in asked) or 2 in found
    assert {r.chunk_id for r in lexical_top_k(queries, tokens, 20, russian_words()).collect()} == found


@pytest.mark.parametrize("analyzer", [None, russian_words()])
def test_words_are_counted_before_they_are_analyzed(spark, analyzer):
    chunks = spark.createDataFrame([(1, "Регламенты и регламент, VPN vpn"), (2, "в регламенте: И её"), (3, ""), (4, None)], "chunk_id bigint, content string")
    each = positions(token_table(chunks, analyzer)).groupBy("term").count()
    assert {tuple(r) for r in term_counts(chunks, analyzer).collect()} == {tuple(r) for r in each.collect()}


def test_statistics_of_terms(spark):
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "chunk_id bigint, content string")
    frame = term_statistics(token_table(chunks))
    assert {tuple(r) for r in frame.collect()} == {("a", 2, 1, 2), ("b", 2, 2, 1), ("c", 1, 1, 1)}


@pytest.mark.parametrize("rows", [positions, postings])
def test_texts_are_analyzed_once(spark, rows):
    chunks = spark.createDataFrame([(1, "a b a")], "chunk_id bigint, content string").repartition(2)
    plan = rows(token_table(chunks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
