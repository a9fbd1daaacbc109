"""Stored postings in blocks with a maximal count, and exact top-k search that stops early.

A block holds up to ``BLOCK`` chunks in which a word occurs about equally often
(``level``); ``top`` is the most it occurs in one of them. The score of a chunk for
a clause of m words is a sum over its minimal spans, each worth ``COVER_WEIGHT`` at
most. A span holds every word of the clause, and an occurrence of a word lies in m
minimal spans at most, so m * COVER_WEIGHT * (occurrences of any one word) bounds
the score. The blocks of a clause's rarest word are read from the highest level
down, in rounds, and every chunk met is scored for the whole query. A chunk that has
not been met stands in unread levels of all clauses, so the highest unread level of
each bounds its score. Once k chunks are known, only levels whose bound reaches the
k-th score are read. What is left out cannot be among the best: the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorehouse import fixed_values as fixed
from lorehouse.functions.text import let
from lorehouse.operators.lexical import Analyzer, holding, needed_keys, parse_queries, ranked, scored_matches
from lorehouse.operators.rare_key import EVERYTHING
from lorehouse.session import cut_lineage

BLOCK = 128
#: Chunks a query reads in its first round, as a multiple of k, and how much larger each round may be.
FIRST, GROWTH = 4, 8
#: Words of all queries together up to which the token table is reduced to them.
WORDS = 4096
#: Scores are rounded to nine digits.
MARGIN = 1e-8


def _level(count: Column) -> Column:
    """Counts up to 8 one by one, then four levels to a doubling."""
    return F.when(count <= 8, count).otherwise(8 + F.floor(F.log2(count / 8) * 4)).cast("int")


def posting_blocks(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(term, level, part, top, n, items)`` of a token table; items are (chunk_id, tf) in order.

    The entry of the empty term lists every chunk. A frequent term is spread
    over its blocks before anything of it meets in one task.
    """
    return _in_blocks(_placed(tokens, block))


def _counts(words: Column) -> Column:
    """(term, tf) of every distinct word, from the runs of the sorted words."""

    def runs(ordered: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(F.when(F.size(ordered) > 0, begins), lambda at: entries(ordered, at))

    def entries(ordered: Column, begins: Column) -> Column:
        end = lambda n: F.coalesce(F.get(begins, n + 1), F.size(ordered))
        return F.transform(begins, lambda at, n: F.struct(F.get(ordered, at).alias("term"), (end(n) - at).cast("int").alias("tf")))

    return let(F.sort_array(words), runs)


def _placed(tokens: DataFrame, block: int) -> DataFrame:
    """``(term, chunk_id, tf, level, part)``: the block of every posting.

    The words of a chunk are counted where it is. Only terms of more than one block are looked up for
    their number of blocks: they are few, so all postings meet for the first time in their block.
    """
    found = F.concat(F.coalesce(_counts(F.array_compact("tokens")), F.array()), F.array(F.struct(F.lit(EVERYTHING).alias("term"), F.lit(0).alias("tf"))))
    # the outer form keeps the optimizer from adding a filter that counts again
    counted = tokens.select("chunk_id", F.inline_outer(found)).withColumn("level", _level(F.col("tf")))
    parts = F.ceil(F.count(F.lit(1)) / block)
    sizes = cut_lineage(counted.groupBy("term", "level").agg(parts.alias("_parts")).filter(F.col("_parts") > 1), "sizes")
    part = F.pmod(F.xxhash64("chunk_id"), F.coalesce("_parts", F.lit(1)))
    return counted.join(sizes, ["term", "level"], "left").withColumn("part", part.cast("int"))


def _in_blocks(placed: DataFrame) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("chunk_id", "tf")))
    return placed.groupBy("term", "level", "part").agg(F.max("tf").alias("top"), F.count(F.lit(1)).alias("n"), items.alias("items"))


def write_blocks(tokens: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Store the blocks sorted by term, so that a reader skips row groups of other terms; returns them."""
    # ranged before they are put together: a sample for the ranges would make all blocks once more
    made = _in_blocks(_placed(tokens, block).repartitionByRange("term", "level", "part"))
    made.sortWithinPartitions("term", "level", "part").write.parquet(path)
    return tokens.sparkSession.read.schema(made.schema).parquet(path)


def _levels(clauses: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, clause, term, level, blocks, n, weight, most)``: what each clause may have to read.

    A clause adds at most weight * (count of the term) to the score of a chunk,
    ``most`` to one of the level.
    """
    needs = needed_keys(clauses)
    heads = blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.count(F.lit(1)).alias("blocks"))
    heads = cut_lineage(heads.join(needs.select(F.col("key").alias("term")), "term", "left_semi"), "heads")
    totals = heads.groupBy(F.col("term").alias("key")).agg(F.sum("n").alias("_n"))
    counted = needs.join(totals, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    weight = F.lit(fixed.COVER_WEIGHT) * F.count_if(F.col("key") != EVERYTHING)
    drivers = counted.groupBy("query_id", "clause").agg(F.min_by("key", F.struct("_n", "key")).alias("term"), weight.alias("weight"))
    most = (F.col("weight") * F.col("top")).alias("most")
    return drivers.join(heads, "term").select("query_id", "clause", "term", "level", "blocks", "n", "weight", most)


def _bounded(unread: DataFrame) -> DataFrame:
    """Add ``other``, what the unread levels of the other clauses may add to a score, and ``bound``, the most a level may reach."""
    query, clause = Window.partitionBy("query_id"), Window.partitionBy("query_id", "clause")
    top = F.col("level") == F.max("level").over(clause)
    marked = unread.withColumn("_first", F.when(top, F.col("most")).otherwise(0.0)).withColumn("_own", F.max("most").over(clause))
    other = F.sum("_first").over(query) - F.col("_own")
    return marked.withColumn("other", other).withColumn("bound", F.col("most") + F.col("other")).drop("_first", "_own")


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """``(query_id, kth)``: the k-th score of the queries that have k chunks already."""
    return ranked(scored, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))


def _asked_words(tokens: DataFrame, clauses: DataFrame) -> DataFrame:
    """The token table with nothing but the words of the queries, each at its place: no other word counts for a match or a score.

    Written once, it is what the rounds meet, and not all words of all chunks again in each. Queries of more than ``WORDS`` words leave the table as it is.
    """
    words = clauses.select(F.explode(F.flatten(F.transform("atoms", lambda a: F.transform(a["words"], lambda w: w["term"])))).alias("term")).distinct()
    asked = [r["term"] for r in words.limit(WORDS + 1).collect()]
    if len(asked) > WORDS:
        return tokens.select("chunk_id", "tokens")
    kept = F.transform("tokens", lambda t: F.when(t.isin(asked), t))
    return cut_lineage(tokens.select("chunk_id", kept.alias("tokens")), "asked-words")


def top_k_by_blocks(
    queries: DataFrame,
    blocks: DataFrame,
    tokens: DataFrame,
    k: int = fixed.CANDIDATES_PER_LIST,
    analyzer: Analyzer | None = None,
    within: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What ``lexical_top_k`` gives, and ``(query_id, read, blocks)``: the blocks read of those of the rarest words.

    ``blocks`` and ``tokens`` are the stored index of the same chunks; with
    ``within`` (chunk_id) only these chunks are matched. Rounds grow, so there
    are few of them even if a query has to read everything.
    """
    clauses = cut_lineage(parse_queries(queries, analyzer), "clauses")
    tokens = _asked_words(tokens, clauses)
    unread = cut_lineage(_levels(clauses, blocks), "levels")
    total = unread.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
    scored, taken, budget = None, None, FIRST * k
    before = Window.partitionBy("query_id").orderBy(F.desc("bound"), "clause").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # the highest level is always read, however large
        sized = _bounded(unread).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        marked = cut_lineage(sized.withColumn("_now", F.col("_before") < budget).drop("_before"), "round")
        now = marked.filter("_now").drop("_now")
        if not now.take(1):
            break
        known = now.withColumn("kth", F.lit(None).cast("double")) if scored is None else now.join(_kth(scored, k), "query_id", "left")
        # written, so that it is broadcast to the blocks instead of shuffling them
        known = cut_lineage(known, "known")
        found = blocks.join(known, ["term", "level"]).select("query_id", "clause", "weight", "other", "kth", F.inline("items"))
        may = F.col("weight") * F.col("tf") + F.col("other") + MARGIN >= F.coalesce("kth", F.lit(0.0))
        found = found.filter(may).select("query_id", "clause", "chunk_id")
        if within is not None:
            found = found.join(within.select("chunk_id"), "chunk_id", "left_semi")
        # written, so that few candidates are broadcast to the token table instead of shuffling it
        matches = scored_matches(holding(cut_lineage(found, "candidates"), clauses, tokens), clauses)
        scored = cut_lineage(matches if scored is None else scored.unionByName(matches).distinct(), "scored")
        taken = now if taken is None else taken.unionByName(now)
        rest = _bounded(marked.filter("NOT _now").drop("_now", "other", "bound")).join(_kth(scored, k), "query_id", "left")
        unread = rest.filter(F.col("bound") + MARGIN >= F.coalesce("kth", F.lit(0.0))).drop("kth", "other", "bound")
        budget *= GROWTH
    if scored is None:
        empty = tokens.sparkSession.createDataFrame([], T.StructType([queries.schema["query_id"], tokens.schema["chunk_id"], T.StructField("score", T.DoubleType())]))
        return ranked(empty, k), total.select("query_id", F.lit(0).cast("bigint").alias("read"), "blocks")
    read = taken.groupBy("query_id").agg(F.sum("blocks").alias("read"))
    return ranked(scored, k), read.join(total, "query_id")
