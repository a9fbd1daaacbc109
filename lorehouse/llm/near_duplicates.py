"""Near-duplicate documents: BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its five-word shingles. Its signature holds, per
register, the first point of a Poisson process over weight: the weight axis is
cut into dyadic layers [0, 1), [1, 2), [2, 4), ...; a shingle of count w runs the
processes of the layers below w, and of the layer that holds w the points whose
mark lies below w. Points come in ascending order, so a process stops at the
largest register of its document. Two registers are equal with the probability
of the weighted Jaccard similarity of the texts.

Equal multisets are one node. Nodes that share a band are candidates: first each
with the most connected node of its bucket, then those that are still in
different classes, unless what each shares with others at all keeps them below
the similarity. Every other candidate is verified on its whole multiset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehouse.llm.blocks import bounded_batches, text_of
from lorehouse.llm.components import components
from lorehouse.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _steps(n: int) -> np.uint64:
    return np.uint64(n * int(_STEP) % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles_of(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of all texts, sorted; a shorter text that has words is one shingle."""
    data = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = bytes(memoryview(data.buffers()[2])[offsets[0] : offsets[-1]]).translate(_WORD_BYTES) if len(data) and offsets[-1] > offsets[0] else b""
    plain = pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(raw)])
    lists = pc.ascii_split_whitespace(plain.view(pa.large_string()))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    filled = np.array([bool(w) for w in words], bool)
    codes = numbered.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(data)), np.diff(lists.offsets.to_numpy()))
    keep = filled[codes] if len(codes) else np.zeros(0, bool)
    doc, code = doc[keep], codes[keep]
    h = hashes[code] if len(code) else np.zeros(0, np.uint64)
    counts = np.bincount(doc, minlength=len(data)) if len(doc) else np.zeros(len(data), np.int64)
    n = len(h)
    total, at = np.zeros(n, np.uint64), np.arange(n)
    last = np.cumsum(counts)[doc] if n else at
    place = np.uint64(1)
    for k in range(size):  # the words of a shingle that its text has; beyond its end nothing is added
        inside = at + k < last
        total[inside] = total[inside] * _STEP + h[at[inside] + k] + place
    first = at == last - (counts[doc] if n else 0)
    whole = (at + size <= last) | (first & (counts[doc] < size) if n else first)
    doc, shingle = doc[whole], mixed(total[whole])
    order = np.argsort(shingle)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(data) <= 65536 else np.int64), kind="stable")]
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1]))) if len(doc) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return doc[starts], shingle[starts], np.diff(np.concatenate((starts, [len(doc)])))


def bag_min_hash(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs x registers) of weighted sets; documents without terms have infinite registers."""
    parts = [(doc, term, weight, np.zeros(len(doc)), np.ones(len(doc)))]
    low = 1
    while True:  # the dyadic layers above [0, 1)
        more = weight > low
        if not more.any():
            break
        k = int(more.sum())
        parts.append((doc[more], mixed(term[more] + _steps(low)), weight[more], np.full(k, float(low)), np.full(k, float(low))))
        low *= 2
    owner, seed, limit, base, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    least = np.full(n_docs * registers, np.inf)
    time = np.zeros(len(owner))
    step = 0
    bound = np.full(n_docs, np.inf)
    while len(owner):
        step += 1
        one = mixed(seed + _steps(step))
        two = mixed(one ^ _STEP)
        time = time - np.log(_unit(one)) / (registers * width)
        counted = time < bound[owner]
        if not counted.all():
            owner, seed, limit, base, width, time, two = (x[counted] for x in (owner, seed, limit, base, width, time, two))
        inside = (base == 0) | (base + width * _unit(two) < limit)
        slot = owner * registers + (mixed(two) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(least, slot[inside], time[inside])
        alive = np.unique(owner) if len(owner) < n_docs else np.arange(n_docs)
        bound[alive] = least.reshape(n_docs, registers)[alive].max(1)
    return least.reshape(n_docs, registers)


def _signed(bands: int, rows: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("_key").to_pylist()
            n = len(texts)
            doc, shingle, count = shingles_of(texts, size)
            least = bag_min_hash(doc, shingle, count, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            folded = np.arange(bands, dtype=np.uint64)[None, :] * _STEP + np.zeros((n, 1), np.uint64)
            for k in range(rows):
                folded = mixed(folded ^ least[:, :, k])
            cuts = np.searchsorted(doc, np.arange(n + 1))
            both = np.stack((shingle, count.astype(np.uint64)), 1)
            nodes = [
                xxhash.xxh3_128_digest(both[a:b].tobytes()) if b > a else xxhash.xxh3_128_digest(f"text {key}")
                for a, b, key in zip(cuts[:-1].tolist(), cuts[1:].tolist(), keys, strict=True)
            ]
            found = [x if b > a else [] for x, a, b in zip(folded.view(np.int64), cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("_key"), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "_key", "node", "bands"],
            )

    return sign


def _listed(size: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, shingle, count = shingles_of(batch.column("text"), size)
            owner, each = np.repeat(doc, count), np.repeat(shingle, count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            # the n-th occurrence is an element of its own: overlap of sets is then overlap of multisets
            each = mixed(each + nth.astype(np.uint64) * _STEP).view(np.int64)
            cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(each))
            yield pa.record_batch([batch.column("node"), lists], names=["node", "elements"])

    return listed


def _text_key() -> Column:
    return F.md5(text_of().cast("binary"))


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose multisets overlap enough."""
    left = elements.select(F.col("node").alias("u"), F.col("elements").alias("_left"))
    right = elements.select(F.col("node").alias("v"), F.col("elements").alias("_right"))
    common = F.size(F.array_intersect("_left", "_right"))
    joined = pairs.join(left, "u").join(right, "v").withColumn("_common", common)
    union = F.size("_left") + F.size("_right") - F.col("_common")
    return joined.where(F.col("_common") >= similarity * union).select("u", "v")


def _bounds(elements: DataFrame, similarity: float) -> DataFrame:
    """Size ``n`` of each multiset and the ``most`` that another one can share with it.

    What only one node has is shared with none, so an overlap is at most the
    rest; nodes that this keeps below the similarity with any other are left out.
    """
    single = elements.select("node", F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.first("node").alias("node"))
    alone = single.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = elements.select("node", F.size("elements").alias("n"))
    bounds = sizes.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    return bounds.where(F.col("most") >= similarity * F.col("n"))


def near_duplicate_classes(
    documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id``, ``_key`` (MD5 of the text) and ``node`` of every row, with ``class_id`` and ``class_node``.

    A class is a connected component of links of at least ``similarity``;
    ``class_id`` is its smallest doc_id (null if it has none). Null texts are
    empty. Texts without words are alike only if they are equal; equal texts are
    always in one class; shorter texts are one shingle; repeated rows stay rows;
    an empty table has no rows; further columns are not read. A link of exactly
    0.8 shares no band with a probability below 0.00005; no bucket is capped.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    keyed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("_key", _text_key())
    signed = cut_lineage(
        keyed.mapInArrow(_signed(bands, rows, size), "doc_id bigint, _key string, node binary, bands array<bigint>"), "signatures"
    )
    nodes = signed.groupBy("node").agg(F.min(F.struct("_key", "doc_id")).alias("rep"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut_lineage(banded.join(shared, "band"), "buckets")

    # the hub of a bucket: the node that meets most others over all its buckets
    weights = held.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = held.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    first = held.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()

    wanted = nodes.join(weights, "node", "left_semi").select("node", F.col("rep._key").alias("_key"), F.col("rep.doc_id").alias("_doc"))
    texts = keyed.join(wanted, "_key").where(F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "text")
    elements = cut_lineage(
        texts.mapInArrow(_listed(size), "node binary, elements array<bigint>").dropDuplicates(["node"]), "elements"
    )
    links = cut_lineage(_verified(first, elements, similarity), "links")
    labels = components(links)

    # candidates that the hubs have not joined
    marked = held.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    torn = marked.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band")
    rest = cut_lineage(marked.join(torn, "band", "left_semi"), "torn")
    bounds = _bounds(elements.join(rest.select("node").distinct(), "node", "left_semi"), similarity)
    listed = rest.groupBy("node").agg(F.collect_list("band").alias("bands"))
    rest = cut_lineage(rest.join(bounds, "node").join(listed, "node"), "rest")
    other = rest.select(
        "band", F.col("node").alias("v"), *[F.col(c).alias(f"_{c}") for c in ("label", "n", "most", "bands")]
    )
    most = F.least("most", "_most")
    apart = (F.col("label") < F.col("_label")) & (most >= similarity * (F.col("n") + F.col("_n") - most))
    # a pair comes from one of the bands that it shares, so it comes once
    apart = apart & (F.col("band") == F.array_min(F.array_intersect("bands", "_bands")))
    second = rest.join(other, "band").where(apart).select(F.col("node").alias("u"), "v").distinct()
    done = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    second = second.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(done, ["u", "v"], "left_anti")
    labels = components(links.union(_verified(second, elements, similarity)))

    of_rows = signed.select("doc_id", "_key", "node").join(labels, "node", "left").withColumn("class_node", F.coalesce("label", "node"))
    ids = of_rows.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    return of_rows.drop("label").join(ids, "class_node")


def keep_one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: of each class the row with the smallest doc_id (null last), then MD5."""
    classes = near_duplicate_classes(documents, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    kept = classes.groupBy("class_node").agg(F.min(order).alias("x")).select("x.doc_id", "x._key")
    times = classes.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text")).join(
        times, (F.col("_doc").eqNullSafe(F.col("doc_id"))) & (F.col("_text") == F.col("_key"))
    ).select("_doc", "_text", "_times")
    own = documents.columns
    rows = documents.withColumn("_text_key", _text_key()).join(
        kept, (F.col("_text_key") == F.col("_text")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc"))
    )
    once = rows.where("_times = 1").select(*own)
    again = rows.where("_times > 1").dropDuplicates(["_doc", "_text"]).select(*own)
    return once.unionByName(again)


def class_digest(documents: DataFrame) -> DataFrame:
    """One row per document: its class and the size of the class."""
    classes = near_duplicate_classes(documents)
    sizes = classes.groupBy("class_node").agg(F.count(F.lit(1)).alias("class_size"))
    return classes.join(sizes, "class_node").select("doc_id", "class_id", "class_size")
