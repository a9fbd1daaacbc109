"""Byte-pair ids and texts against the tokenizers library, and the pair test against plain merging."""

import hashlib
import random

import pyarrow as pa
import pytest

from lorehouse.llm import byte_pairs

ALPHABETS = ["abcdefghij  \n\t'sdtm", "aaab  ", "ÄÖüßéè 'S 12٣½²", "한국어 日本語 🙂👍🏽 ‍́", "\x00\x01\x1c\x1d\x85\xa0 　 ab", "İıΣς𐐀\U0001e900 ͸՘"]


@pytest.fixture(scope="module")
def made():
    return byte_pairs.PrefixEncoder()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_pairs.VOCABULARY)


def texts(seed):
    rng = random.Random(seed)
    for _ in range(700):
        k = rng.random()
        if k < 0.5:
            yield "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 40)))
        elif k < 0.7:
            yield "".join(rng.choice(rng.choice(ALPHABETS[:3])) for _ in range(rng.randint(0, 400)))
        elif k < 0.9:
            yield "".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(rng.randint(1, 20))) if not 0xD800 <= c < 0xE000)
        else:
            yield "<|endoftext|>".join(rng.choice(["a ", " x", "", "<|", " 1"]) for _ in range(5))


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_library(made, library, seed):
    some = list(texts(seed))
    for text, ids in zip(some, made.encode_all(pa.array(some, pa.string())), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_characters_that_unicode_versions_judge_differently(made, library):
    some = [f"ab{c}cd 1{c}2 {c}" for c in (chr(0x558), chr(0x88F), chr(0x1C89), chr(0x10940))]
    for text, ids in zip(some, made.encode_all(pa.array(some)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["x" * 40000, "ab" * 20000, " " * 30000, "\n" * 999 + "a", "🙂" * 5000])
def test_long_pieces(made, library, text):
    (ids,) = made.encode_all(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_like_the_library(made, library):
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(data, rank):
    parts = [bytes([b]) for b in data]
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return parts
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_the_pair_test_agrees_with_merging(made):
    rank = {(made.bytes_of[a], made.bytes_of[b]): r for (a, b), r in made.rank.items()}
    rng = random.Random(2)
    tokens = [n for n in made.last_rank if len(made.bytes_of[n]) < 9]
    short = [n for n in tokens if len(made.bytes_of[n]) < 3]
    for _ in range(4000):
        a, b = rng.choice(short if rng.random() < 0.5 else tokens), rng.choice(short if rng.random() < 0.5 else tokens)
        both = merged(made.bytes_of[a] + made.bytes_of[b], rank)
        assert made.apart(a, b) == (both == [made.bytes_of[a], made.bytes_of[b]])


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        byte_pairs.PrefixEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_table_round_trip(documents, rows, library):
    coded = byte_pairs.decode_ids(byte_pairs.encode_texts(documents)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in coded], key=key) == sorted(rows, key=key)
    for r in coded:
        assert r.decoded == (r.text or "") and r.lang == "en" and r.kept == "old"
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids


def test_digest(documents, rows, library, nothing):
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = [tuple(r) for r in byte_pairs.coding_digest(documents).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert byte_pairs.coding_digest(nothing).count() == 0 and byte_pairs.encode_texts(nothing).count() == 0


def test_clashing_and_null_columns(spark):
    frame = spark.createDataFrame([("a b", [1, None, 90000], "x"), (None, None, None)], "text string, ids array<int>, decoded string")
    assert [r.decoded for r in byte_pairs.decode_ids(frame).collect()] == ['"', ""]
    assert [r.ids for r in byte_pairs.encode_texts(frame).collect()] == [[64, 275], []]
