"""Token ids as flat unsigned integer files with 64-bit document offsets.

A store is a folder with one file pair per block of ascending doc_id:

* ``<block>.ids``: the ids of all its documents one after the other, unsigned
  little-endian, two bytes wide where the vocabulary allows it, else four;
* ``<block>.idx``: little-endian 64-bit integers: the doc_ids, then the place of
  every document's first id in the whole store, then the end of the block;
* ``manifest``: one row per block: documents, null doc_ids (they come first), ids
  and the ids of all blocks before it, which is a prefix sum over the blocks.

Files are written under a name of their own and renamed, so a task that runs
twice leaves the same file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse.llm.blocks import BLOCK, bounded_batches, in_blocks, rows_of, running_base, text_of, with_block
from lorehouse.session import cut_lineage, fresh_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Pieces between blanks whose ids a worker keeps, and their longest length.
KEPT_PIECES, KEPT_CHARS = 1_200_000, 48
#: Pieces that are encoded together, and how few are so in the end where their words cannot be counted.
TOGETHER, FEW = 32_768, 256
#: Stands between pieces that are encoded together (a picture of a record separator).
_MARK = "\u241e"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _words(piece: str) -> int:
    """Number of words that the pre-tokenizer makes of a piece."""
    return 1 if piece.isalpha() else len(_WORD.findall(piece.lower()))


def _alike(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct pieces.

    The vocabulary knows no upper case, and a run of ASCII marks between a
    small Latin letter or digit and a blank is a word of its own in any case. Of
    other letters that need not be so: some end in a combining mark once they are
    normalized or set in small letters, and that joins the marks. Only special
    tokens, which stand in angle and upright bars, are sensitive to case.
    """
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9ß-öø-ÿ])([!-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")


class PieceEncoder:
    """The ids of whole texts, from the ids of their pieces between blanks.

    The pre-tokenizer of the vocabulary drops white space and no token crosses
    it, so a text's ids are those of its pieces in order. A batch is split and
    its distinct pieces are numbered by Arrow; pieces not yet known are encoded
    together, and the ids are gathered by number.
    """

    def __init__(self, path: str = VOCABULARY, end_id: int = END_ID) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = array("I", [end_id]).tobytes()
        self.known: dict[str, bytes] = {}
        self.mark = self._ids(_MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encoded(self, pieces: list[str], together: int = TOGETHER) -> Iterator[tuple[str, bytes]]:
        """The ids of distinct pieces, in their order: many are encoded as one text, which is cut at the ends of words.

        Where the words of a piece cannot be counted (``_words``), fewer are
        taken together, and at last a mark stands between them instead: its ids
        mean the mark's bytes and a word's end, so they occur nowhere else unless
        a piece holds the mark itself; few pieces among which is such a one, or a
        special token, are encoded singly.
        """
        for at in range(0, len(pieces), together):
            some = pieces[at : at + together]
            joined = " ".join(some)
            odd = _MARK in joined or "<|" in joined
            ids = None if odd else self._ids(joined)
            counts = None if odd else np.fromiter(map(_words, some), np.int64, len(some))
            ends = None if odd else np.flatnonzero(self.last[ids]) + 1
            if not odd and counts.sum() == len(ends):
                cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
                begins, stops = cuts[:-1], cuts[1:]
            elif together > FEW:
                yield from self._encoded(some, max(FEW, together // 16))
                continue
            elif odd:
                yield from ((p, self._ids(p).tobytes()) for p in some)
                continue
            else:
                ids = self._ids(f" {_MARK} ".join([*some, ""]))
                width = len(self.mark)
                same = [ids[k : len(ids) - width + 1 + k] == m for k, m in enumerate(self.mark)]
                stops = np.flatnonzero(np.logical_and.reduce(same))
                begins = np.concatenate(([0], stops[:-1] + width))
            raw = ids.tobytes()
            for piece, a, b in zip(some, (4 * begins).tolist(), (4 * stops).tolist(), strict=True):
                yield piece, raw[a:b]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (32 bits, each text with its end id) and the n + 1 places at which the texts begin and end."""
        if texts.offset:  # Arrow's ascii_lower reads past the end of large strings that begin within a buffer
            texts = pa.concat_arrays([texts, texts.slice(0, 0)])
        lists = pc.ascii_split_whitespace(_alike(texts.fill_null("").cast(pa.large_string())))
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        raw = list(map(known.get, pieces))
        new = [k for k, ids in enumerate(raw) if ids is None]
        for k, (piece, ids) in zip(new, self._encoded([pieces[k] for k in new]), strict=True):
            raw[k] = ids
            if len(piece) <= KEPT_CHARS:
                known[piece] = ids
        raw.append(self.end)
        sizes = np.fromiter(map(len, raw), np.int32, len(raw)) // 4
        flat = np.frombuffer(b"".join(raw), "<u4")
        firsts = (np.cumsum(sizes) - sizes).astype(np.int32)
        places = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = np.insert(numbered.indices.to_numpy(zero_copy_only=False), places[1:], len(pieces))
        lengths = sizes[codes]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        shift = (firsts[codes] - (stops - lengths)).astype(np.int32)  # batches are far below 2^31 ids
        ids = flat[np.repeat(shift, lengths) + np.arange(total, dtype=np.int32)]
        return ids, np.concatenate(([0], stops[codes == len(pieces)]))

    def width(self) -> int:
        """Bytes of an id in the files."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder of a vocabulary."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def _placed(folder: str, name: str, data: Callable[[pa.NativeFile], None]) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        data(out)
    fs.move(own, f"{root}/{name}")


def _integers(folder: str, name: str, kind: str) -> np.ndarray:
    """A file's integers: memory-mapped where the folder is mounted, else read."""
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem):
        with fs.open_input_file(path) as source:
            return np.frombuffer(source.read(), kind)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(block, its batches) of batches sorted by block."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            blocks = batch.column(BLOCK).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(blocks[a]), batch.slice(a, b - a)

    for key, group in groupby(parts(), key=lambda p: p[0]):
        yield key, (p[1] for p in group)


def _write_ids(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end_id)
        kind = f"<u{encode.width()}"
        for block, parts in of_blocks(batches):
            docs: list[int | None] = []
            lengths: list[int] = []

            def ids(out: pa.NativeFile, parts=parts, docs=docs, lengths=lengths) -> None:
                for part in parts:
                    docs.extend(part.column("doc_id").to_pylist())
                    flat, places = encode(part.column("text"))
                    lengths.extend(np.diff(places).tolist())
                    out.write(flat.astype(kind).tobytes())

            _placed(folder, f"{block}.ids", ids)
            index = np.array([[d or 0 for d in docs], lengths], "<i8")
            _placed(folder, f"{block}.len", lambda out, index=index: out.write(index.tobytes()))
            values = [block, len(docs), sum(d is None for d in docs), sum(lengths)]
            yield pa.record_batch([pa.array([v], pa.int64()) for v in values], names=[BLOCK, "n_docs", "n_null", "n_ids"])

    return write


def _write_index(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, base in rows_of(iter([batch]), BLOCK, "base"):
                docs, lengths = _integers(folder, f"{block}.len", "<i8").reshape(2, -1)
                index = np.concatenate((docs, [base], base + np.cumsum(lengths))).astype("<i8")
                _placed(folder, f"{block}.idx", lambda out, index=index: out.write(index.tobytes()))
            yield batch

    return write


def write_tokens(documents: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> str:
    """Encode every text and write the store; returns its folder.

    Documents are in ascending doc_id order (null first; equal ids by text);
    null and empty texts have the end id alone; repeated rows are repeated
    documents; an empty table gives a store without blocks. Columns beside
    doc_id and text are not read. ``folder`` must be seen by all executors: a
    mounted folder or a URI that Arrow's file systems know.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    blocked, n = with_block(documents.select("doc_id", text_of().alias("text")), "doc_id")
    ordered = in_blocks(blocked, n).sortWithinPartitions(BLOCK, "doc_id", "text")
    sizes = cut_lineage(
        ordered.mapInArrow(_write_ids(folder, vocabulary, end_id), f"{BLOCK} bigint, n_docs bigint, n_null bigint, n_ids bigint"),
        "token-sizes",
    )
    based = running_base(sizes, [BLOCK], "n_ids", "base")
    in_blocks(based, n).mapInArrow(_write_index(folder), based.schema).write.parquet(f"{folder}/manifest")
    return folder


def read_tokens(spark: SparkSession, folder: str, width: int | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of a store's documents."""
    kind = f"<u{width or PieceEncoder().width()}"
    manifest = spark.read.schema(f"{BLOCK} bigint, n_docs bigint, n_null bigint, n_ids bigint, base bigint").parquet(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, n_docs, n_null in rows_of(batches, BLOCK, "n_docs", "n_null"):
            index, flat = _integers(folder, f"{block}.idx", "<i8"), _integers(folder, f"{block}.ids", kind)
            docs, places = index[:n_docs], index[n_docs:]
            for at in range(0, n_docs, 500):
                to = min(at + 500, n_docs)
                raw = [flat[a - places[0] : b - places[0]].astype("<u4") for a, b in zip(places[at:to], places[at + 1 : to + 1], strict=True)]
                ids = [None if k < n_null else int(d) for k, d in enumerate(docs[at:to], at)]
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(np.array(places[at:to])),
                    pa.array(np.diff(places[at : to + 1])),
                    pa.array([zlib.crc32(r.tobytes()) for r in raw], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r.astype(np.int64) for r in raw], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    blocks = (manifest.agg(F.max(BLOCK)).first()[0] or 0) + 1
    return in_blocks(manifest, blocks).mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    )


def token_digest(documents: DataFrame) -> DataFrame:
    """One row per document from a store written and read back."""
    return read_tokens(documents.sparkSession, write_tokens(documents), with_ids=False)
