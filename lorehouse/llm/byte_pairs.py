"""Byte-pair encoding without merging: the last token of every prefix, and decoding.

The encoding of a prefix ends in exactly one token. A token that ends at a place
is that token if the prefix before it is empty, or if the prefix's own last token
and this one stay apart, that is if merging their joined bytes gives just the two.
So a piece is encoded from left to right: an automaton over the vocabulary names
the tokens that end at each byte, the pair test picks the one that fits, and the
ids are read by following the stored tokens back from the end. Work grows with the
length of a piece, however long it is.

Texts are cut into pieces by the vocabulary's own rule first, as no token crosses
one; a worker keeps the ids of the pieces it has met. Ids are exactly those of the
tokenizers library (`add_special_tokens=False`, no truncation, no padding).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorehouse.llm.blocks import bounded_batches, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces and token pairs a worker keeps, and the longest piece that is kept.
KEPT_PIECES, KEPT_PAIRS, KEPT_CHARS = 1_000_000, 2_000_000, 64

# The pieces of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _runs(characters: list[str], form: str) -> str:
    """Sorted characters as the ranges of a character class."""
    groups = [[ord(c) for _, c in run] for _, run in groupby(enumerate(characters), lambda x: ord(x[1]) - x[0])]
    return "".join(f"{form.format(g[0])}-{form.format(g[-1])}" for g in groups)


def _plane_pattern() -> re.Pattern:
    """The rule for characters up to U+FFFF with its classes spelled out, which the standard matcher looks up in a table."""
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letters, digits, blanks = (_runs(regex.findall(kind, plane), "\\u{:04x}") for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digits}]+| ?[^{blanks}{letters}{digits}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )


def _byte_letters() -> dict[str, str]:
    """The printable letter that stands for each byte in a vocabulary file, as a map back to that byte (Latin-1).

    Printable bytes stand for themselves, the others for the letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(0x100 + k): chr(b) for k, b in enumerate(others)}


class PrefixEncoder:
    """The ids of texts by the last token of every prefix, and the texts of ids."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._require(spec)
        model = spec["model"]
        back = _byte_letters()
        names = {token: "".join(map(back.__getitem__, token)) for token in model["vocab"]}
        ids = {names[token]: n for token, n in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The bytes of every id, in the order of ids; ids that nothing has give no bytes.
        self.bytes_of = [b""] * (1 + max([*ids.values(), *added.values()]))
        for name, n in ids.items():
            self.bytes_of[n] = name.encode("latin-1")
        for name, n in added.items():
            self.bytes_of[n] = name.encode()
        self.decimal = [str(n) for n in range(len(self.bytes_of))]
        self.added = {name: np.array([n], "<u4").tobytes() for name, n in added.items()}
        longest = sorted(map(regex.escape, added), key=len, reverse=True)
        self.cut_added = regex.compile(f"({'|'.join(longest)})").split if added else lambda text: [text]

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        single = {n for name, n in ids.items() if len(name) == 1}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((ids[names[a]], ids[names[b]]), rank)
        #: How a token comes about when its bytes are merged: rank of the last merge (-1: a byte), left and right part.
        self.last_rank = dict.fromkeys(single, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for (a, b), rank in self.rank.items():
            made = ids[(self.bytes_of[a] + self.bytes_of[b]).decode("latin-1")]
            if made in self.last_rank or a not in self.last_rank or b not in self.last_rank:
                continue  # a part that merging never gives, or a token that an earlier merge gives
            if self.apart(a, b, rank):
                self.last_rank[made], self.left[made], self.right[made] = rank, a, b
        self.ending = ahocorasick.Automaton()
        for n in self.last_rank:
            name = self.bytes_of[n].decode("latin-1")
            self.ending.add_word(name, (n, len(name)))
        self.ending.make_automaton()

        self.find, self.find_in_plane = regex.compile(PIECES).findall, _plane_pattern().findall
        self._ask_about_letters(path)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _require(spec: dict) -> None:
        """Vocabularies of this kind only: byte-level pieces, plain merges, plain added tokens."""
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        flags = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model["type"] != "BPE" or spec["normalizer"] or not plain or odd or flags:
            raise ValueError(f"not a plain byte-level vocabulary: {odd or flags or pre}")

    def _ask_about_letters(self, path: str) -> None:
        """Characters that are letters or digits for one Unicode version only: texts with them are cut by the library."""
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        new = "".join(c for c in map(chr, range(0x370, 0x110000)) if unicodedata.category(c) == "Cn")
        odd = [c for c in regex.findall(r"[\p{L}\p{N}\s]", new) if len(self.cut(f"a{c}a")) != len(self.find(f"a{c}a")) or len(self.cut(f"1{c}1")) != len(self.find(f"1{c}1"))]
        self.odd = f"[{_runs(odd, '\\x{{{:x}}}')}]" if odd else None

    def apart(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether merging the bytes of two tokens leaves the two, as far as merges ranked lower than ``below`` go.

        The merges of both sides are undone from the last to the first; whenever
        the two tokens at the border have a merge that would have come before
        the one undone last, the border would not have lasted. Of two equal
        merges the left one comes first.
        """
        rank, last = self.rank, self.last_rank
        while True:
            if rank.get((left, right), below) < below:
                return False
            a, b = last[left], last[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                below, left = a, self.right[left]
            else:
                below, right = b + 1, self.left[right]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        data = piece.encode("utf-8").decode("latin-1")
        token_at, size_at = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        pairs = self.pairs
        for place, (token, size) in self.ending.iter(data):
            place += 1
            if token_at[place] >= 0:
                continue
            before = place - size
            if before:
                pair = (token_at[before], token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.apart(*pair)
                if not fits:
                    continue
            token_at[place], size_at[place] = token, size
        ids, place = [], len(data)
        while place:
            ids.append(token_at[place])
            place -= size_at[place]
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        return np.array(ids[::-1], "<u4").tobytes()

    def _pieces_by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.cut(text)]

    def encode(self, text: str, find: Callable[[str], list[str]] | None = None) -> bytes:
        """The ids of a text; ``find`` cuts it into pieces."""
        find = find or self._pieces_by_library
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        out: list[bytes] = []
        for k, part in enumerate(self.cut_added(text)):
            if k % 2:
                out.append(self.added[part])
                continue
            pieces = find(part)
            raw = list(map(self.known.get, pieces))
            if None in raw:
                for at, ids in enumerate(raw):
                    if ids is None:
                        raw[at] = ids = self.known.get(pieces[at]) or self.encode_piece(pieces[at])
                        if len(pieces[at]) <= KEPT_CHARS:
                            self.known[pieces[at]] = ids
            out.extend(raw)
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text."""
        high = pc.match_substring_regex(texts, r"[\x{10000}-\x{10ffff}]").to_pylist()
        odd = pc.match_substring_regex(texts, self.odd).to_pylist() if self.odd else [False] * len(texts)
        for text, beyond, judged in zip(texts.to_pylist(), high, odd, strict=True):
            find = self._pieces_by_library if judged else self.find if beyond else self.find_in_plane
            yield np.frombuffer(self.encode(text, find), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes, broken UTF-8 sequences as U+FFFD; ids that the vocabulary has not are left out."""
        known = len(self.bytes_of)
        return b"".join([self.bytes_of[n] for n in ids if 0 <= n < known]).decode("utf-8", "replace")


_ENCODERS: dict[str, PrefixEncoder] = {}


def prefix_encoder(path: str = VOCABULARY) -> PrefixEncoder:
    """The worker's encoder of a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``ids``, the token ids of every whole text.

    Null and empty texts have no ids; rows are independent of each other, so
    repeated rows repeat and an empty table stays empty. Other columns pass
    through; a column named ``ids`` is replaced. One pass, no shuffle.
    """
    bounded_batches(documents.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(vocabulary)
        for batch in batches:
            lists = list(encoder.encode_all(batch.column("text").fill_null("")))
            places = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, "<u4"), *lists]).astype(np.int32)
            yield batch.append_column("ids", pa.ListArray.from_arrays(pa.array(places), pa.array(flat)))

    kept = documents.drop("ids")
    return kept.mapInArrow(encode, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(frame: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``, the text of ``ids`` with special tokens kept.

    Null lists and lists without ids give empty texts; null ids and ids that the
    vocabulary has not are left out. Other columns pass through; a column named
    ``decoded`` is replaced.
    """
    bounded_batches(frame.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(vocabulary)
        for batch in batches:
            texts = [encoder.decode([n for n in ids or [] if n is not None]) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    kept = frame.drop("decoded")
    return kept.mapInArrow(decode, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def coding_digest(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, number and digest of the ids, and digest of the text decoded from them, per document.

    Encodes and decodes like the two functions above, in one pass that keeps the
    ids inside the worker. Null texts count as empty; null doc_ids stay null.
    """
    bounded_batches(documents.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(vocabulary)
        decimal = encoder.decimal.__getitem__
        for batch in batches:
            sizes, ids_sha, decoded_sha = [], [], []
            for array in encoder.encode_all(batch.column("text")):
                ids = array.tolist()
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select("doc_id", text_of().alias("text"))
    doc_id = T.StructField("doc_id", documents.schema["doc_id"].dataType)
    rest = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(digest, T.StructType([doc_id, *rest]))
