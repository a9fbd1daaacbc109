"""Phrases of a few words that keep together, per language.

Phrases are counted level by level. The trie of a level holds all frequent words,
all frequent shorter phrases, and phrases of this length that repeat in a task's
first texts; it is a double array, broadcast, and bounded (``WORDS``, ``PHRASES``).
A task advances the states of all its text positions at once, one level after the
other, and counts accepting states in one array. A phrase can only be frequent if
its first and last words but one are (Apriori), so every other phrase is left out;
one that may be frequent but is not in the trie is counted by its own name. All
counts of all tasks are summed, so the result is exact whatever the trie holds:
bounds and proposals only decide where a count is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorehouse.llm.blocks import bounded_batches, text_of
from lorehouse.llm.double_array import DoubleArray
from lorehouse.session import cut_lineage

#: Words of a trie, and phrases of each length, at most: about 100 MB in a worker.
WORDS, PHRASES = 1 << 19, 1 << 20
#: Bytes of text that a task counts at once, phrases a task proposes, and how often these occur in its first texts.
SHARD_BYTES, PROPOSALS, REPEATED = 6 << 20, 5_000, 3
#: Rows of a batch that a task gives out.
SLICE = 50_000
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 300_000
#: Numbers below 10**14 keep a * a * 1000000 and l * r within 38 digits.
_COUNT = "decimal(14,0)"
_ROWS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_ROWS_SQL = "lang string, words int, phrase string, f bigint"
_BREAK = ","


@dataclass
class Words:
    """The words of some texts of one language in order: numbers of distinct words, and which of them are words at all."""

    index: np.ndarray
    distinct: pa.Array
    is_word: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Lower-case words; pieces, and texts, are parted by a break."""
    plain = pc.ascii_lower(texts)
    plain = pc.replace_substring_regex(plain, r"[.,;:!?\x0a-\x0d]+", f" {_BREAK} ")
    ended = pc.binary_join_element_wise(plain, pa.scalar(_BREAK, plain.type), pa.scalar(" ", plain.type))
    tokens = pc.ascii_split_whitespace(ended).flatten()
    tokens = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
    index = tokens.indices.to_numpy(zero_copy_only=False)
    distinct = tokens.dictionary
    breaks = pc.index(distinct, pa.scalar(_BREAK, distinct.type)).as_py()
    return Words(index, distinct, index != breaks)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[str, Words]]]:
    """The texts of a task in shards of bounded size, by language; the words of one language are made at a time."""

    def shard(some: list[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
        langs = pa.concat_arrays([b.column("lang") for b in some])
        texts = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in some])
        some.clear()
        for lang in langs.unique().to_pylist():
            yield lang, words_of(texts.filter(pc.equal(langs, lang)))

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= SHARD_BYTES:
            yield shard(held)
            held, size = [], 0
            # what the shard took goes back, instead of staying with the worker while others grow
            pa.default_memory_pool().release_unused()
    if held:
        yield shard(held)


def _rows(lang: str, words: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, words, np.int32))]
    return pa.record_batch([*columns, phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], schema=_ROWS)


def _distinct(words: Words, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct phrase of ``length`` words that begins at some places, and how often it does."""
    key, first = words.index[places].astype(np.int64), None
    for k in range(1, length):
        # numbers of distinct phrases stay small, so that keys stay within 64 bits
        key = key * len(words.distinct) + words.index[places + k]
        if k < length - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return places[first], counts


def _phrases(words: Words, places: np.ndarray, length: int) -> pa.Array:
    """The phrases of ``length`` words at some places."""
    parts = [words.distinct.take(pa.array(words.index[places + k])) for k in range(length)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))


def _count_words(longest: int):
    """Counts of all words and of a language's words together (0 words); proposals are named by negative lengths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                values = np.fromiter(counts.values(), np.int64, len(counts))
                yield _rows(lang, 1, pa.array(counts.keys(), pa.string()), values)
                yield _rows(lang, 0, pa.array([""]), values.sum(keepdims=True))
            held.clear()

        for number, shard in enumerate(_shards(batches)):
            for lang, words in shard:
                mine = held.setdefault(lang, {})
                tally = np.bincount(words.index[words.is_word], minlength=len(words.distinct))
                seen = np.flatnonzero(tally)
                for word, n in zip(words.distinct.take(pa.array(seen)).to_pylist(), tally[seen].tolist(), strict=True):
                    mine[word] = mine.get(word, 0) + n
                inside = words.is_word
                for length in range(2, longest + 1) if not number else ():
                    inside = inside[:-1] & words.is_word[length - 1 :]
                    places = np.flatnonzero(inside)
                    if len(places):
                        firsts, counts = _distinct(words, places, length)
                        best = np.argsort(-counts, kind="stable")[:PROPOSALS]
                        best = best[counts[best] >= REPEATED]
                        yield _rows(lang, -length, _phrases(words, firsts[best], length), counts[best])
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from passed()
        yield from passed()

    return count


class PhraseTrie:
    """The double array of one level with the words that its letters stand for.

    ``complete[k]`` says whether all frequent phrases of k words are in it;
    where they are not, a phrase that it does not know may still be frequent.
    """

    def __init__(self, words: pa.Table, phrases: list[pa.Table], complete: dict[int, bool]) -> None:
        """Tables of lang and phrase: ``words``, sorted by language, and phrases of 2, 3, ... words."""
        self.complete = complete
        self.langs, self.names = (words[c].combine_chunks().cast(pa.string()) for c in ("lang", "phrase"))
        runs = self.langs.value_counts() if len(words) else []
        stops = np.cumsum([r["counts"].as_py() for r in runs]).tolist()
        #: Where the words of a language begin and end.
        self.spans = {r["values"].as_py(): (b - r["counts"].as_py(), b) for r, b in zip(runs, stops, strict=True)}
        self.array = DoubleArray(max(1, len(words)), sum(map(len, phrases)))
        for length, level in enumerate(phrases, 2):
            for lang in self.spans:
                some = level["phrase"].filter(pc.equal(level["lang"], lang)).combine_chunks()
                if not len(some):
                    continue
                letters = self._letters(lang, pc.split_pattern(some, " ").flatten()).reshape(-1, length)
                states = letters[:, 0]
                for k in range(1, length - 1):
                    states = self.array.step(states, letters[:, k])
                fit = (states >= 0) & (letters[:, -1] >= 0)
                self.array.add(states[fit], letters[fit, -1])

    def plain(self) -> dict:
        """Its fields without classes of this package, for a broadcast."""
        return vars(self) | {"array": vars(self.array)}

    @classmethod
    def of(cls, fields: dict) -> PhraseTrie:
        """The trie of such fields."""
        array = DoubleArray.__new__(DoubleArray)
        vars(array).update(fields["array"])
        trie = cls.__new__(cls)
        vars(trie).update(fields | {"array": array})
        return trie

    def _letters(self, lang: str, words: pa.Array) -> np.ndarray:
        """The letter of every word; -1: not in the trie."""
        first, stop = self.spans.get(lang, (0, 0))
        found = pc.index_in(words.cast(pa.string()), self.names.slice(first, stop - first)).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(found >= 0, found + first, -1).astype(np.int32)

    def letters(self, lang: str, words: Words) -> np.ndarray:
        """The letter of every place of a text; -1: a break, or not in the trie."""
        return np.where(words.is_word, self._letters(lang, words.distinct)[words.index], np.int32(-1))

    def advance(self, lang: str, words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Accepting states of phrases of ``length`` words, and places of such phrases that the trie does not hold but may be frequent."""
        letters = self.letters(lang, words)
        states, inside = letters, words.is_word
        for k in range(2, length + 1):
            may = (states >= 0) if self.complete[k - 1] else np.ones(len(states), bool)
            states = self.array.step(states[:-1], letters[k - 1 :])
            inside = inside[:-1] & words.is_word[k - 1 :]
        safe = inside & may[:-1] & may[1:]
        return states[safe & (states >= 0)], np.flatnonzero(safe & (states < 0))

    def named(self, states: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        """The languages and phrases of states."""
        path = [pa.array(letters) for letters in self.array.path(states, length)]
        parts = [self.names.take(p) for p in path]
        return self.langs.take(path[0]), pc.binary_join_element_wise(*parts, " ")


def _count_phrases(held: Broadcast, length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PhraseTrie.of(held.value)
        tally = np.zeros(len(trie.array.check), np.int64)
        for shard in _shards(batches):
            for lang, words in shard:
                states, rest = trie.advance(lang, words, length)
                found = np.bincount(states)
                tally[: len(found)] += found
                # phrases are named, and taken over by the JVM, slice by slice
                firsts, counts = _distinct(words, rest, length) if len(rest) else (rest, rest)
                for at in range(0, len(firsts), SLICE):
                    yield _rows(lang, length, _phrases(words, firsts[at : at + SLICE], length), counts[at : at + SLICE])
        accepted = np.flatnonzero(tally)
        for at in range(0, len(accepted), SLICE):
            some = accepted[at : at + SLICE]
            langs, phrases = trie.named(some, length)
            yield pa.record_batch([langs, pa.array(np.full(len(some), length, np.int32)), phrases, pa.array(tally[some])], schema=_ROWS)

    return count


def _largest(rows: DataFrame, n: int) -> tuple[pa.Table, bool]:
    """The most frequent rows (lang, phrase), sorted, and whether these are all.

    Whole classes of counts are taken (eight to a doubling) while they are ``n``
    rows or fewer together, so what reaches the driver is bounded.
    """
    kind = F.floor(F.log2("f") * 8)
    sizes = rows.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total <= n:
            least = r["kind"]
    some = rows.where(kind >= least if least is not None else F.lit(False)).select("lang", "phrase", "f").toArrow()
    return some.sort_by([("lang", "ascending"), ("f", "descending"), ("phrase", "ascending")]).select(["lang", "phrase"]), total <= n


def count_phrases(documents: DataFrame, least: int = 10, longest: int = 3, max_words: int = WORDS, max_phrases: int = PHRASES) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, and all words together (0 words, "").

    Texts are set in small letters (A to Z) and cut into pieces at stops, commas,
    semicolons, colons, exclamation and question marks and line ends; words are
    parted by blanks and tabs. Occurrences may overlap and never cross a piece. A
    null language is ``und``, a null text has no words; repeated rows count
    each. An empty table gives no rows. Columns beside lang and text are not read.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    summed = lambda rows: rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    first = summed(texts.mapInArrow(_count_words(longest), _ROWS_SQL))
    first = cut_lineage(first.where((F.col("words") <= 0) | (F.col("f") >= least)), "phrases-1")
    words, complete = _largest(first.where("words = 1"), max_words)
    found = [first.where("words >= 0")]
    known, all_in = [], {1: complete}
    for length in range(2, longest + 1):
        proposed, _ = _largest(first.where(F.col("words") == -length), max_phrases // 8)
        trie = PhraseTrie(words, [*known, proposed], all_in)
        held = spark.sparkContext.broadcast(trie.plain())
        counted = summed(texts.mapInArrow(_count_phrases(held, length), _ROWS_SQL))
        found.append(cut_lineage(counted.where(F.col("f") >= least), f"phrases-{length}"))
        more, complete = _largest(found[-1], max_phrases)
        known.append(more)
        all_in[length] = complete and all_in[length - 1]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _parts(k: str) -> tuple[F.Column, F.Column]:
    """The first k words of a phrase, and the others."""
    first = F.expr(f"substring_index(phrase, ' ', {k})")
    return first, F.expr(f"substring_index(phrase, ' ', {k} - words)")


def score_phrases(counts: DataFrame, covered: int = 50) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more that no longer one covers.

    A phrase cut after its first words has l occurrences of the first part, r of
    the rest and the score floor(1000000 a a / (l r)), in exact arithmetic; its
    lowest cut counts, of equal ones the first. A phrase is covered if its words
    stand in a longer one, itself covered or not, with at least ``covered``
    percent of its occurrences.
    """
    phrases = counts.where("words >= 2").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first, rest = _parts("k")
    cuts = cuts.withColumns({"first": first, "rest": rest})
    known = counts.where("words >= 1")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    number = lambda c: f"cast({c} as {_COUNT})"
    exact = f"(cast(1000000 as decimal(7,0)) * {number('a')} * {number('a')}) div ({number('l')} * {number('r')})"
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(exact).cast("bigint"))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = (
        phrases.where("words >= 3")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .select("lang", F.expr("array_join(slice(split(phrase, ' '), at, size), ' ')").alias("phrase"), F.col("a").alias("f"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    kept = lowest.join(shorter, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def phrase_digest(documents: DataFrame, first: int = 2000, **limits: int) -> DataFrame:
    """The ``first`` phrases of each language by score, then occurrences, then their bytes."""
    scored = score_phrases(count_phrases(documents, **limits))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
