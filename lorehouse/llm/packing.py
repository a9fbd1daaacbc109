"""Packing into training sequences: order-preserving dynamic programming over cut places.

The ids of the documents of a block stand one after the other. Cuts may fall at
document ends (free), at all sentence ends (``SENTENCE``) and, in long stretches
without either, at every ``GRAIN``-th id (``TRUNCATION``). A sequence from cut i to cut j
costs its padding, a fixed charge, and the penalty of cut j, so

    cost(j) = penalty(j) + charge + length - c(j) + min over i (cost(i) + c(i)),

over the i at most ``length`` ids before j: a sliding minimum, kept in a
monotone queue. Sequences of a power of two need no padding; they are added as
direct transitions. All cuts are judged together, not greedily.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.llm.blocks import BLOCK, bounded_batches, in_blocks, running_base, text_of, with_block
from lorehouse.llm.tokens import END_ID, VOCABULARY, PieceEncoder, encoder, of_blocks
from lorehouse.session import cut_lineage

LENGTH = 2048
SENTENCE, TRUNCATION, CHARGE, GRAIN = 6.0, 24.0, 8.0, 16
#: Sequences planned together, and the last of them that are planned again with what follows.
PLANNED, OPEN = 256, 4
_ENDS = set(".!?…。！？")


def sentence_ends(encode: PieceEncoder) -> np.ndarray:
    """By id: is it a token of sentence-ending marks only."""
    vocabulary = encode.tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, number in vocabulary.items():
        mark = token.removesuffix("</w>")
        out[number] = bool(mark) and set(mark) <= _ENDS
    return out


def cut_places(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut places, from 0 to the end, and their penalties.

    Every document end and every sentence end is one; stretches of over four grains without any get cuts of the dear kind.
    """
    n = len(ids)
    kind = np.full(n + 1, np.inf)
    kind[np.flatnonzero(marks[ids]) + 1] = SENTENCE
    kind[ends] = 0.0
    kind[0], kind[n] = 0.0, min(kind[n], TRUNCATION)
    known = np.flatnonzero(np.isfinite(kind))
    wide = np.flatnonzero(np.diff(known) > 4 * grain)
    for a, b in zip(known[wide].tolist(), known[wide + 1].tolist(), strict=True):
        kind[a + grain : b : grain] = TRUNCATION
    places = np.flatnonzero(np.isfinite(kind))
    return places, kind[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cut places of the cheapest packing, from the first to the last."""
    n = len(places)
    # sequences that need no padding though they are short: pairs (end, start) in the order of their ends
    ends, starts = [], []
    size = 64
    while size < length:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero(places[at] == places - size)
        ends.append(hit)
        starts.append(at[hit])
        size *= 2
    ends, starts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ends, starts))
    order = np.argsort(ends, kind="stable")
    short_end, short_start = [*ends[order].tolist(), n], [*starts[order].tolist(), 0]
    c = places.tolist()
    oldest = np.searchsorted(places, places - length).tolist()
    cost, came = [0.0] * n, [0] * n
    values, holders = [0.0] * n, [0] * n  # the queue: ascending values of cost + place, from ``head`` to ``tail``
    values[0] = float(c[0])
    head = tail = at = 0
    for j, first, here, charge in zip(range(1, n), oldest[1:], c[1:], (penalties[1:] + CHARGE).tolist(), strict=True):
        while holders[head] < first:
            head += 1
        i = holders[head]
        best = values[head] + length - here
        while short_end[at] == j:
            k = short_start[at]
            if cost[k] < best:
                best, i = cost[k], k
            at += 1
        cost[j] = best = best + charge
        came[j] = i
        best += here
        while tail >= head and values[tail] >= best:
            tail -= 1
        tail += 1
        values[tail] = best
        holders[tail] = j
    cuts, j = [c[-1]], n - 1
    while j:
        j = came[j]
        cuts.append(c[j])
    return cuts[::-1]


def tail_cuts(start: int, end: int, length: int = LENGTH) -> list[int]:
    """Cuts inside the last sequence: powers of two as long as that is cheaper than padding."""
    rest, cuts, best, spent = end - start, [], [], 0.0
    least = float(length - rest) if rest & (rest - 1) else 0.0
    at = start
    while rest:
        top = 1 << (rest.bit_length() - 1)
        at, rest = at + top, rest - top
        if not rest:
            break
        cuts.append(at)
        spent += CHARGE + TRUNCATION
        total = spent + (length - rest if rest & (rest - 1) else 0)
        if total < least:
            least, best = total, list(cuts)
    return best


class _Packer:
    """Packs the documents of one block, a bounded stretch of ids at a time."""

    def __init__(self, marks: np.ndarray, length: int) -> None:
        self.marks, self.length = marks, length
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, place of its first id, number of ids
        self.held = 0
        self.sequence = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, self.held, len(ids)))
        self.held += len(ids)

    def full(self) -> bool:
        return self.held >= PLANNED * self.length

    def pack(self, last: bool) -> Iterator[tuple]:
        """The pieces of all sequences that are settled."""
        ids = np.concatenate(self.parts)
        starts = np.array([d[1] for d in self.docs])
        ends = starts + np.array([d[2] for d in self.docs])
        places, penalties = cut_places(ids, ends, self.marks)
        cuts = best_cuts(places, penalties, self.length)
        if last:
            cuts[-1:] = [*tail_cuts(cuts[-2], cuts[-1], self.length), cuts[-1]]
        else:
            del cuts[-OPEN:]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
                doc_id, begin, size = self.docs[k]
                x, y = max(a, begin), min(b, begin + size)
                yield doc_id, x - begin, y - x, zlib.crc32(ids[x:y].tobytes()), size, self.sequence, x - a
            self.sequence += 1
        done = cuts[-1]
        self.docs = [(d, s - done, n) for d, s, n in self.docs if s + n > done]
        self.parts, self.held = [ids[done:]], self.held - done


_PIECES = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(), "_local": pa.int64(), "offset": pa.int64(),
}
_MARKS: dict[str, np.ndarray] = {}


def _pack_blocks(vocabulary: str, end_id: int, length: int):
    def pieces(block: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _PIECES]
        arrays = [pa.array(c, t) for c, t in zip(columns, _PIECES.values(), strict=True)]
        return pa.record_batch([pa.array([block] * len(rows), pa.int64()), *arrays], names=[BLOCK, *_PIECES])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end_id)
        if vocabulary not in _MARKS:
            _MARKS[vocabulary] = sentence_ends(encode)
        for block, parts in of_blocks(batches):
            packer = _Packer(_MARKS[vocabulary], length)
            for part in parts:
                flat, places = encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), places[:-1], places[1:], strict=True):
                    packer.add(doc_id, flat[a:b])
                    if packer.full():
                        yield pieces(block, list(packer.pack(False)))
            yield pieces(block, list(packer.pack(True)))

    return pack


def pack_documents(documents: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Sequences of at most ``length`` ids from all documents, in ascending doc_id order.

    One row per piece: doc_id, start (in its document), length, ids_crc32,
    doc_tokens, sequence_id, offset (in its sequence). Null and empty texts are
    documents of the end id alone; equal and null doc_ids stay documents of their
    own; very long texts are cut into as many pieces as they need; an empty table
    has no pieces; columns beside doc_id and text are not read. Blocks are packed
    apart, so at most the last sequence of a block is short.
    """
    bounded_batches(documents.sparkSession)
    blocked, n = with_block(documents.select("doc_id", text_of().alias("text")), "doc_id")
    ordered = in_blocks(blocked, n).sortWithinPartitions(BLOCK, "doc_id", "text")
    schema = f"{BLOCK} bigint, " + ", ".join(f"{k} bigint" for k in _PIECES)
    packed = cut_lineage(ordered.mapInArrow(_pack_blocks(vocabulary, end_id, length), schema), "pieces")
    sizes = packed.groupBy(BLOCK).agg((F.max("_local") + 1).alias("n"))
    bases = running_base(sizes, [BLOCK], "n", "_base").select(BLOCK, "_base")
    return packed.join(bases, BLOCK).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_local")).alias("sequence_id"), "offset"
    )
