"""Removal of passages that stand in an earlier document, from sorted runs of suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id. Sorting the suffixes of all places would exchange
the corpus many times over, so suffixes are taken at anchors: the place with the
least hash of 16 bytes among the 35 that a window of 50 bytes has. Equal windows
have equal anchors at equal distances, so nothing is lost. The steps, each over
blocks of ascending doc_id:

1. documents that repeat an earlier text as a whole are found by their MD5;
2. the hashes of a block's anchors are exchanged as sorted runs of differences;
   only anchors that two documents share go on;
3. the suffixes at shared anchors (with the bytes before them that a window can
   have) are sorted, front-coded and exchanged by anchor; loser trees merge the
   runs without comparing known prefixes again; every window of a group gets the
   first document that has it;
4. each block cuts the windows that an earlier document has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorehouse.llm.blocks import BLOCK, bounded_batches, in_blocks, rows_of, text_of, with_block
from lorehouse.llm.front_coding import decode_keys, decode_rows, encode_keys, encode_rows, merge_runs
from lorehouse.llm.near_duplicates import mixed
from lorehouse.llm.tokens import _placed, of_blocks
from lorehouse.session import fresh_path

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # places of a gram in a window
#: Bytes of a record: 50 from the anchor on, 34 before it, and the two distances of its zone.
ROW = LENGTH + SPAN - 1 + 2
#: Merged records that are answered together, up to the end of their group.
SETTLED = 50_000
#: Bytes of a block of documents and of the stretch that is hashed at once.
BLOCK_BYTES, STRETCH = 8 << 20, 2 << 20
_KEY_BITS = 40
_NOBODY = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def anchors_of(data: np.ndarray) -> np.ndarray:
    """Per window start the key of its anchor (40 bits) and the anchor's place (24 bits), leftmost of equal keys."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    h = mixed(h)
    low = np.uint64((1 << 24) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (SPAN - size)], h[SPAN - size :])


def _stretches(docs: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Stretches of joined bytes with their parts: (document, place in it, begin, end in the stretch).

    A longer document comes in parts that overlap by a window less one byte.
    """
    held: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    size = 0
    for doc, raw in docs:
        for at in range(0, max(1, len(raw) - LENGTH + 1), STRETCH):
            piece = raw[at : at + STRETCH + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            held.append(piece)
            parts.append((doc, at, size, size + len(piece)))
            size += len(piece)
            if size >= STRETCH:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                held, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(held), np.uint8), parts


class _Zones:
    """Runs of window starts with one anchor: document, key, first window, distances to the anchor."""

    def __init__(self, data: np.ndarray, parts: list[tuple[int, int, int, int]]) -> None:
        found = anchors_of(data)
        inside = np.zeros(len(found), bool)
        begins = np.array([p[2] for p in parts])
        for _, _, a, b in parts:
            inside[a : b - LENGTH + 1] = True
        starts = np.flatnonzero(inside)
        found = found[starts]
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        last = np.concatenate((new[1:], [len(found)])) - 1
        self.data = data
        self.low = starts[new]
        self.anchor = (found[new] & np.uint64((1 << 24) - 1)).astype(np.int64)
        self.key = found[new] >> np.uint64(24)
        self.far = self.anchor - self.low
        self.near = self.anchor - starts[last]
        part = np.searchsorted(begins, self.low, "right") - 1
        self.doc = np.array([p[0] for p in parts])[part]
        self.place = self.low - begins[part] + np.array([p[1] for p in parts])[part]

    def records(self, chosen: np.ndarray) -> np.ndarray:
        """The suffix from the anchor on, then the bytes before it going backwards; zeros beyond the zone."""
        anchor, far, near = self.anchor[chosen, None], self.far[chosen, None], self.near[chosen, None]
        ahead, back = np.arange(LENGTH)[None, :], np.arange(SPAN - 1)[None, :]
        top = len(self.data) - 1
        right = np.where(ahead < LENGTH - near, self.data[np.minimum(anchor + ahead, top)], 0)
        left = np.where(back < far, self.data[np.maximum(anchor - 1 - back, 0)], 0)
        return np.concatenate((right, left), 1).astype(np.uint8)


def _load(folder: str, name: str) -> bytes | None:
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as source:
        return source.read()


def _integers(raw: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind) if raw else np.empty(0, kind)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    texts = pc.struct_field(part.column("_row"), "text").fill_null("")
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _documents(folder: str, block: int, parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(number in the block, rank, bytes) of the documents that repeat no earlier one as a whole."""
    copies = set(_integers(_load(folder, f"{block}.copies"), "<i8").tolist())
    for part in parts:
        columns = zip(part.column("_seq").to_pylist(), part.column("_rank").to_pylist(), _texts(part), strict=True)
        yield from (x for x in columns if x[0] not in copies)


def _shared_in_block(keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The keys that documents of two ranks have, ascending."""
    order = np.lexsort((ranks, keys))
    k, r = keys[order], ranks[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (r[1:] != r[:-1])])


def _part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return ((keys >> np.uint64(_KEY_BITS - 24)) * np.uint64(n_parts) >> np.uint64(24)).astype(np.int64)


def _cut_by_part(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    return ((int(parts[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_RUN = ["_part", BLOCK, "n", "run"]
_RUN_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_RUN_SCHEMA = f"_part bigint, {BLOCK} bigint, n bigint, run binary"


def _anchor_runs(folder: str, n_parts: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in of_blocks(batches):
            found = [np.empty(0, np.uint64)]
            for data, pieces in _stretches((seq, raw) for seq, _, raw in _documents(folder, block, parts)):
                found.append(np.unique(_Zones(data, pieces).key))
            keys = np.unique(np.concatenate(found))
            yield _table([(p, block, b - a, encode_keys(keys[a:b])) for p, a, b in _cut_by_part(_part_of(keys, n_parts))], _RUN, _RUN_KINDS)

    return runs


def _common_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a part the keys that another run of it has."""
    for part, group in groupby(rows_of(batches, *_RUN), key=lambda r: r[0]):
        runs = [(block, decode_keys(run)) for _, block, _, run in group]
        together = np.sort(np.concatenate([keys for _, keys in runs]))
        common = np.unique(together[1:][together[1:] == together[:-1]])
        if len(common):
            kept = [(block, keys[np.isin(keys, common, assume_unique=True)]) for block, keys in runs]
            yield _table([(part, block, len(k), encode_keys(k)) for block, k in kept if len(k)], _RUN, _RUN_KINDS)


def _gather(folder: str, suffix: str, merged):
    """Write, per block, what the parts have for it, in the order of the parts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in groupby(rows_of(batches, BLOCK, "_part", "run"), key=lambda r: r[0]):
            data = merged([run for _, _, run in group])
            _placed(folder, f"{block}.{suffix}", lambda out, data=data: out.write(data))
            yield pa.record_batch([pa.array([block], pa.int64())], names=[BLOCK])

    return gather


def _suffix_runs(folder: str, n_parts: int):
    """Sorted front-coded runs of the suffixes at shared anchors; where they stand is written beside the block.

    Equal zones of a block are one record with the rank of the first document that has it.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in of_blocks(batches):
            ranks: dict[int, int] = {}

            def docs(block=block, parts=parts, ranks=ranks) -> Iterator[tuple[int, bytes]]:
                for seq, rank, raw in _documents(folder, block, parts):
                    ranks[seq] = rank
                    yield seq, raw

            zones = [_Zones(data, pieces) for data, pieces in _stretches(docs())]
            if not zones:
                continue
            rank_of = [np.array([ranks[d] for d in z.doc.tolist()]) for z in zones]
            own = _shared_in_block(np.concatenate([z.key for z in zones]), np.concatenate(rank_of))
            shared = np.union1d(own, _integers(_load(folder, f"{block}.shared"), "<u8"))
            chosen = [np.flatnonzero(np.isin(z.key, shared)) for z in zones]

            def column(name: str, zones=zones, chosen=chosen) -> np.ndarray:
                return np.concatenate([getattr(z, name)[c] for z, c in zip(zones, chosen, strict=True)])

            key, doc, place, far, near = map(column, ("key", "doc", "place", "far", "near"))
            rank = np.concatenate([r[c] for r, c in zip(rank_of, chosen, strict=True)])
            rows = np.concatenate([z.records(c) for z, c in zip(zones, chosen, strict=True)])
            rows = np.concatenate((rows, far[:, None].astype(np.uint8), near[:, None].astype(np.uint8)), 1)
            del zones
            if not len(rows):
                continue
            part = _part_of(key, n_parts)
            order = np.lexsort((rank, np.ascontiguousarray(rows).view(f"S{ROW}").ravel(), part))
            rows, part, rank = rows[order], part[order], rank[order]
            new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1) | (part[1:] != part[:-1])))
            record = np.cumsum(new) - 1
            first = rank == rank[new][record]
            stood = np.stack((record, doc[order], place[order], far[order], near[order], first)).astype("<i8")
            _placed(folder, f"{block}.zones", lambda out, stood=stood: out.write(zstandard.compress(stood.tobytes(), 3)))
            rows, part, rank = rows[new], part[new], rank[new].astype("<i8")
            yield _table(
                [
                    (p, block, b - a, encode_rows(rows[a:b]), zstandard.compress(rank[a:b].tobytes(), 1))
                    for p, a, b in _cut_by_part(part)
                ],
                [*_RUN, "ranks"],
                [*_RUN_KINDS, pa.binary()],
            )

    return runs


def _windows_first(rows: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per record and distance from window to anchor the first document with that window (rows of one part, distinct)."""
    n = len(rows)
    ahead, back = np.zeros((n, LENGTH + 1), np.uint64), np.zeros((n, SPAN), np.uint64)
    for k in range(LENGTH):
        ahead[:, k + 1] = mixed(ahead[:, k] * _power(1) + rows[:, k] + np.uint64(1))
    for k in range(SPAN - 1):
        back[:, k + 1] = mixed(back[:, k] * _power(1) + rows[:, LENGTH + k] + np.uint64(1))
    far, near = rows[:, -2], rows[:, -1]
    first = np.full((n, SPAN), _NOBODY)
    salt = mixed(group.astype(np.uint64) * _power(1))
    for o in range(SPAN):
        has = np.flatnonzero((near <= o) & (o <= far))
        if len(has):
            window = mixed(ahead[has, LENGTH - o] ^ mixed(back[has, o] + salt[has]))
            order = np.argsort(window)
            starts = np.flatnonzero(np.concatenate(([True], window[order][1:] != window[order][:-1])))
            lowest = np.minimum.reduceat(least[has[order]], starts)
            sizes = np.diff(np.concatenate((starts, [len(order)])))
            first[has[order], o] = np.repeat(lowest, sizes)
    return first


class _Merged:
    """Collects merged records up to a whole number of groups and answers for each run which windows are late."""

    def __init__(self, runs: list[list[bytes]], ranks: list[np.ndarray]) -> None:
        self.runs, self.ranks = runs, ranks
        self.late = [np.zeros(len(r), np.uint64) for r in ranks]
        self.clear()

    def clear(self) -> None:
        self.rows: list[bytes] = []
        self.groups: list[int] = []
        self.seen: list[tuple[int, int, int]] = []

    def settle(self) -> None:
        if not self.rows:
            return
        rows = np.frombuffer(b"".join(self.rows), np.uint8).reshape(-1, ROW)
        run, place, record = np.array(self.seen).T
        rank = np.array([self.ranks[r][p] for r, p, _ in self.seen], np.int64)
        least = np.full(len(rows), _NOBODY)
        np.minimum.at(least, record, rank)
        first = _windows_first(rows, np.array(self.groups), least)
        late = (first[record] < rank[:, None]) @ (np.uint64(1) << np.arange(SPAN, dtype=np.uint64))
        for r, p, bits in zip(run.tolist(), place.tolist(), late.tolist(), strict=True):
            self.late[r][p] = bits
        self.clear()


def _late_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a part; per run and record the windows (a bit per distance) that an earlier document has."""
    for part, group in groupby(rows_of(batches, *_RUN, "ranks"), key=lambda r: r[0]):
        blocks, runs, ranks = [], [], []
        for _, block, n, run, held in group:
            blocks.append(block)
            runs.append(decode_rows(run, n, ROW))
            ranks.append((block << 32) + _integers(held, "<i8"))
        merged, number = _Merged([r[0] for r in runs], ranks), 0
        for run, place, common in merge_runs(runs):
            if common < GRAM:
                number += 1
                if len(merged.rows) >= SETTLED:
                    merged.settle()
            if common < ROW or not merged.rows:
                merged.rows.append(runs[run][0][place])
                merged.groups.append(number)
            merged.seen.append((run, place, len(merged.rows) - 1))
        merged.settle()
        late = [zstandard.compress(x.tobytes(), 1) for x in merged.late]
        yield _table([(part, b, len(x), z) for b, x, z in zip(blocks, merged.late, late, strict=True)], _RUN, _RUN_KINDS)


def _removed(folder: str, block: int) -> dict[int, list[tuple[int, int]]]:
    """Per document of a block (by number) the maximal runs of bytes to remove."""
    stood = _integers(_load(folder, f"{block}.zones"), "<i8").reshape(6, -1)
    late = _integers(_load(folder, f"{block}.late"), "<u8")
    if not stood.size:
        return {}
    record, doc, place, far, near, first = stood
    bits = np.where(first == 1, late[record], ~np.uint64(0))
    docs, starts = [], []
    for o in range(SPAN):
        hit = np.flatnonzero((near <= o) & (o <= far) & ((bits >> np.uint64(o)) & np.uint64(1)).astype(bool))
        docs.append(doc[hit])
        starts.append(place[hit] + far[hit] - o)
    docs, starts = np.concatenate(docs), np.concatenate(starts)
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    if not len(docs):
        return {}
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + LENGTH)))
    begins = np.flatnonzero(new)
    ends = np.concatenate((begins[1:], [len(docs)])) - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(docs[begins].tolist(), starts[begins].tolist(), (starts[ends] + LENGTH).tolist(), strict=True):
        out.setdefault(d, []).append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MADE = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        *(T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("spans", _SPANS),
    ]
)


def _cut(folder: str, as_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in of_blocks(batches):
            copies = set(_integers(_load(folder, f"{block}.copies"), "<i8").tolist())
            removed = _removed(folder, block)
            for part in parts:
                kept, sizes, gone, spans = [], [], [], []
                for seq, raw in zip(part.column("_seq").to_pylist(), _texts(part), strict=True):
                    runs = [(0, len(raw))] if seq in copies else removed.get(seq, [])
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    sizes.append(len(raw))
                    gone.append(len(raw) - len(kept[-1]))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                if as_text:
                    kept = [k.decode("utf-8", "ignore") for k in kept]
                columns = [pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, [len(s) for s in spans])), pa.array(spans, span)]
                yield pa.record_batch([part.column("_row"), *columns], names=["_row", *_MADE.names])

    return cut


def remove_repeats(documents: DataFrame, block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """The documents with ``kept`` (bytes that remain, or the text of the whole characters among them), ``n_bytes``, ``n_removed``, ``n_spans`` and ``spans``.

    Spans are the maximal removed runs as byte offsets of the UTF-8 text; windows
    are judged on the input. Texts of fewer than 50 bytes, empty and null ones
    have no window and lose nothing. A null doc_id counts as smaller than any
    number; rows of equal doc_id do not remove from each other. Other columns
    pass through; ones named like the results are replaced. An empty table has no
    rows. Hot passages cost one record per block and distinct surrounding.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop(*_MADE.names)
    folder = fresh_path(spark, "suffixes")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), text_of().alias("_text"))
    blocked, n = with_block(rows, "_doc", block_bytes, "_text")
    order = Window.partitionBy(BLOCK).orderBy("_doc", "_text")
    placed = in_blocks(blocked.withColumn(BLOCK, F.col(BLOCK).cast("bigint")), n).select(
        BLOCK, "_doc", F.row_number().over(order).cast("bigint").alias("_seq"),
        F.dense_rank().over(Window.partitionBy(BLOCK).orderBy("_doc")).cast("bigint").alias("_rank"), "_row",
    )
    # one file, one row group per block: later passes read whole blocks where they lie, without a shuffle
    placed.write.option("compression", "zstd").option("parquet.block.size", str(1 << 30)).parquet(f"{folder}/blocks")
    blocks = spark.read.schema(placed.schema).parquet(f"{folder}/blocks")

    raw = F.coalesce(F.col("_row.text"), F.lit("")).cast("binary")
    low = F.coalesce("_doc", F.lit(-(1 << 63)).cast("bigint"))
    texts = blocks.select(BLOCK, "_seq", low.alias("_doc"), F.md5(raw).alias("_md5"), F.octet_length(raw).alias("n")).where(f"n >= {LENGTH}")
    firsts = texts.groupBy("_md5").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copies = texts.join(firsts, "_md5").where("_doc > _first").select(BLOCK, "_seq")
    _run(in_blocks(copies, n).sortWithinPartitions(BLOCK, "_seq").mapInArrow(_write_copies(folder), f"{BLOCK} bigint"))

    anchors = blocks.mapInArrow(_anchor_runs(folder, n), _RUN_SCHEMA)
    common = _of_parts(anchors, n).mapInArrow(_common_keys, _RUN_SCHEMA)
    joined = _gather(folder, "shared", lambda runs: zstandard.compress(np.concatenate([decode_keys(r) for r in runs]).tobytes(), 1))
    _run(_of_blocks(common, n).mapInArrow(joined, f"{BLOCK} bigint"))

    suffixes = blocks.mapInArrow(_suffix_runs(folder, n), _RUN_SCHEMA + ", ranks binary")
    late = _of_parts(suffixes, n).mapInArrow(_late_windows, _RUN_SCHEMA)
    joined = _gather(folder, "late", lambda runs: zstandard.compress(np.concatenate([_integers(r, "<u8") for r in runs]).tobytes(), 1))
    _run(_of_blocks(late, n).mapInArrow(joined, f"{BLOCK} bigint"))

    made = [T.StructField("kept", T.StringType()), *_MADE.fields[1:]] if as_text else _MADE.fields
    schema = T.StructType([T.StructField("_row", documents.select(F.struct("*")).schema[0].dataType), *made])
    return blocks.mapInArrow(_cut(folder, as_text), schema).select("_row.*", *_MADE.names)


def _of_parts(runs: DataFrame, n: int) -> DataFrame:
    return runs.repartitionById(n, F.col("_part").cast("int")).sortWithinPartitions("_part", BLOCK)


def _of_blocks(runs: DataFrame, n: int) -> DataFrame:
    return in_blocks(runs, n).sortWithinPartitions(BLOCK, "_part")


def _run(frame: DataFrame) -> None:
    """Run a job for the files it writes."""
    frame.agg(F.count(F.lit(1))).collect()


def _write_copies(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in of_blocks(batches):
            seqs = np.concatenate([p.column("_seq").to_numpy() for p in parts]).astype("<i8")
            _placed(folder, f"{block}.copies", lambda out, seqs=seqs: out.write(zstandard.compress(seqs.tobytes(), 1)))
            yield pa.record_batch([pa.array([block], pa.int64())], names=[BLOCK])

    return write


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with what remains of their texts, and its length; other columns as they were.

    Bytes of a character that a cut has split are left out. A text of which
    nothing remains is empty.
    """
    own = documents.columns
    cut = remove_repeats(documents, as_text=True)
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in own:
        cut = cut.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(documents.schema["n_chars"].dataType))
    return cut.select(*own)


def repeat_digest(documents: DataFrame) -> DataFrame:
    """One row per document with what was removed."""
    cut = remove_repeats(documents.select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
