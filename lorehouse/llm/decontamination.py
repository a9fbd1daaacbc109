"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are taken as UTF-8 bytes; A-Z become a-z, every other ASCII byte that is
no digit or letter becomes a blank, all further bytes stay. That keeps the
length, so a place in the normalised text is the same place in the original.
The automaton holds the windows with a blank at either end and scans the words
of a text once; its state moves over overlapping windows without backing up.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorehouse.llm.blocks import bounded_batches
from lorehouse.session import cut_lineage

WINDOW = 10
#: Bytes of windows in one automaton; larger benchmarks are scanned in parts of this size.
PART_BYTES = 16 << 20
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_PLAIN = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_FOUND = {
    "n_words": pa.int64(),
    "hits": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "item_ids": pa.list_(pa.string()),
}

_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_n_hit", _RUNS),
    T.StructField("_hits", _RUNS),
    T.StructField("_item_ids", T.ArrayType(T.StringType())),
]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def windows_of(text: str | None, size: int = WINDOW) -> set[bytes]:
    """All runs of ``size`` words, or the whole of a shorter text that has words."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, found = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for window in windows_of(text, size):
                items.append(item)
                found.append(window)
        yield pa.record_batch([pa.array(items, pa.string()), pa.array(found, pa.binary())], names=["item_id", "window"])


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        built = ahocorasick.Automaton()
        for window, items in patterns:
            built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        if len(built):
            built.make_automaton()
        _AUTOMATA[key] = built
    return _AUTOMATA[key]


def _scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit runs of words as (first, past the last), items."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    plain = f" {b' '.join(words).decode('latin-1')} "
    matches = list(automaton.iter(plain))
    if not matches:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(blanks, np.array([end for end, _ in matches]))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, ends - np.array([n for _, (n, _) in matches]), 1)
    np.add.at(change, ends, -1)
    hit = np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]))
    edges = np.diff(hit)
    runs = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
    return len(words), runs, {item for _, (_, items) in matches for item in items}


def _byte_runs(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as byte offsets of the original text."""
    if not runs:
        return []
    word = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_PLAIN), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [{"start": int(first[a]), "end": int(last[b - 1])} for a, b in runs]


def _scanner(held, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, held.value)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_words", "n_hit", "hits", "item_ids")}
            for text in batch.column("text").to_pylist():
                n, runs, items = _scan(text, automaton)
                out["n_words"].append(n)
                out["hits"].append(_byte_runs(text, runs))
                out["item_ids"].append(sorted(items))
                out["n_hit"].append([{"start": a, "end": b} for a, b in runs])
            kinds = {"n_words": _FOUND["n_words"], "n_hit": _FOUND["hits"], "hits": _FOUND["hits"], "item_ids": _FOUND["item_ids"]}
            for name, kind in kinds.items():
                batch = batch.append_column(f"_{name}", pa.array(out[name], kind))
            yield batch

    return scan


def _joined(runs: F.Column) -> F.Column:
    """Number of words in the union of sorted-by-start runs."""
    step = F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(r["end"] - F.greatest(s["to"], r["start"]), F.lit(0))).alias("n"),
            F.greatest(s["to"], r["end"]).alias("to"),
        ),
    )
    return step["n"]


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hits`` and ``item_ids`` to every document.

    ``hits`` are the byte ranges, in the original UTF-8 text, of the runs of
    words that lie in an occurrence of a window; ``item_ids`` are the items (as
    strings, sorted, each once) with an occurring window; ``n_hit`` counts the
    words in hits. Null or wordless texts have no words and no hits; wordless
    items have no window; a null item_id reads as "". Repeated documents are
    judged each on its own; repeated items count once per id. Other columns pass
    through; columns named like the results are replaced. Documents are read
    once without a shuffle. Windows are dealt into parts of ``part_bytes`` by
    running size; only one part is on the driver and in a broadcast at a time.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    made = ["n_words", "n_hit", "hits", "item_ids"]
    documents = documents.drop(*made)
    windows = (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
        .mapInArrow(lambda b: _windows(b, window), "item_id string, window binary")
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x))
    windows = cut_lineage(windows, "windows")
    total = windows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    own = [c for c in documents.columns]
    frame = documents
    kept: list[str] = []
    for part in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        held = spark.sparkContext.broadcast([(bytes(r["window"]), list(r["items"])) for r in rows])
        frame = frame.mapInArrow(_scanner(held, uuid.uuid4().hex), T.StructType([*frame.schema.fields, *_ADDED]))
        names = {f"_{n}": f"_{n}_{part}" for n in made}
        frame = frame.withColumnsRenamed(names)
        kept.append(str(part))
        if part + 1 < parts:
            frame = cut_lineage(frame, "scanned")

    def union(name: str) -> F.Column:
        return F.flatten(F.array(*[F.col(f"_{name}_{k}") for k in kept])) if len(kept) > 1 else F.col(f"_{name}_0")

    return frame.select(
        *own,
        F.col("_n_words_0").alias("n_words"),
        _joined(union("n_hit")).alias("n_hit"),
        F.array_sort(union("hits")).alias("hits"),
        F.array_sort(F.array_distinct(union("item_ids"))).alias("item_ids"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their own columns."""
    own = documents.columns
    return find_leaks(documents, benchmark, window).where("n_hit = 0").select(*own)


def leak_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the figures of its hits."""
    found = find_leaks(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    """The digest of a sorted list of ids (for tests)."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
