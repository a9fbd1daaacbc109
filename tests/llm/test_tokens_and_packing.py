"""Token files and packing against the tokenizers library, document by document."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from lorehouse.llm import packing, tokens


@pytest.fixture(scope="module")
def encode():
    made = tokens.PieceEncoder()
    return lambda text: np.array([*made.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ODD = ["", None, "a b  c\t\n<|endoftext|> it's\x1cok x␞ ␞ ́x", "ΣΑΣ Σ ΑΣ İx 한국어 don't 12a b c", "יִ a\x0b\x0c\r b", "A.B., c,d. e. . ,", "x" * 5000, "Ｅ１ ｆ．", "TARİHİ. x", "क़. x \u05d9\u05b4, y", "é. É! ß? I\u0307. Σ, ΑΣ."]


def test_pieces_give_the_ids_of_whole_texts(encode):
    made = tokens.PieceEncoder()
    for _ in range(2):  # the second time all pieces are known
        ids, places = made(pa.array(ODD, pa.string()))
        for text, a, b in zip(ODD, places[:-1], places[1:], strict=True):
            assert ids[a:b].tolist() == encode(text).tolist(), repr(text)[:40]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(encode, seed):
    rng = random.Random(seed)
    high = [chr(c) for c in range(0x80, 0x3000) if regex.match(r"[\p{L}\p{N}\p{M}\p{Zs}]", chr(c))]
    some = []
    for _ in range(1500):
        pool = rng.choice(["abAB 1'st", "İIıi\u0307 Σσς", "क़ड़ \ufb1dا", "éÉßẞœ ½²"]) + "".join(rng.sample(high, 3))
        some.append("".join(rng.choice(pool) + rng.choice(["", "", "", ".", ", ", "! ", " ", "\n", ".) "]) for _ in range(rng.randint(1, 30))))
    ids, places = tokens.PieceEncoder()(pa.array(some))
    for text, a, b in zip(some, places[:-1], places[1:], strict=True):
        assert ids[a:b].tolist() == encode(text).tolist(), repr(text)


def test_parts_of_a_batch(encode):
    made = tokens.PieceEncoder()
    some = pa.array([f"Text {n} É. " * (n % 7) for n in range(400)])
    for at in (0, 3, 100, 399):
        ids, places = made(some.slice(at, 150))
        want = [encode(t).tolist() for t in some.slice(at, 150).to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)] == want


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def test_files_hold_all_ids_in_order(documents, rows, encode, spark):
    folder = tokens.write_tokens(documents)
    found = [tuple(r) for r in tokens.read_tokens(spark, folder).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text in sorted(rows, key=order):
        ids = encode(text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    assert found == want
    assert tokens.token_digest(documents).count() == len(rows)


def test_pieces_cover_all_ids_once(documents, rows, encode):
    found = packing.pack_documents(documents).collect()
    sequences, covered = defaultdict(int), defaultdict(list)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(encode(text))
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences[r.sequence_id] and r.length > 0
        sequences[r.sequence_id] += r.length
        covered[r.doc_id].append(r)
        assert any(
            len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[r.doc_id]
        )
    assert max(sequences.values()) <= 2048 and sorted(sequences) == list(range(len(sequences)))
    for doc_id, some in texts.items():
        assert sum(map(len, some)) == sum(r.length for r in covered[doc_id])
        if len(some) == 1:
            at = 0
            for r in sorted(covered[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length


def test_empty_tables(nothing):
    assert tokens.token_digest(nothing).count() == 0
    assert packing.pack_documents(nothing).count() == 0


def slow_cuts(places, penalties, length):
    cost = [0.0] + [np.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = int(places[j] - places[i])
            if size <= length:
                pad = 0 if size >= 64 and not size & (size - 1) else length - size
                cost[j] = min(cost[j], cost[i] + pad + penalties[j] + packing.CHARGE)
    return cost[-1]


@pytest.mark.parametrize("seed", range(8))
def test_the_queue_finds_the_cheapest_cuts(seed):
    rng = random.Random(seed)
    places = np.cumsum([0] + [rng.choice([1, 5, 16, 32, 37, 64]) for _ in range(200)])
    penalties = np.array([0.0] + [rng.choice([0.0, packing.SENTENCE, packing.TRUNCATION]) for _ in range(200)])
    cuts = packing.best_cuts(places, penalties, 256)
    at = {int(p): x for p, x in zip(places, penalties, strict=True)}
    total = 0.0
    for a, b in zip(cuts, cuts[1:], strict=False):
        assert 0 < b - a <= 256
        total += (0 if b - a >= 64 and not (b - a) & (b - a - 1) else 256 - (b - a)) + at[b] + packing.CHARGE
    assert cuts[0] == 0 and cuts[-1] == places[-1]
    assert total == pytest.approx(slow_cuts(places, penalties, 256))


@pytest.mark.parametrize("seed", range(4))
def test_all_sentence_ends_are_cut_places(seed):
    rng = np.random.default_rng(seed)
    marks = np.array([False, False, True])
    ids = np.concatenate([rng.choice(3, 600, p=[0.5, 0.4, 0.1]), np.zeros(200, int), [2, 2, 0, 2], rng.choice(3, 96)])
    ends = np.array([150, 151, 410, len(ids)])
    places, penalties = packing.cut_places(ids, ends, marks)
    found = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    free = {0, *ends.tolist()}
    sentences = {k + 1 for k, x in enumerate(ids.tolist()) if x == 2} - free
    assert {p for p, x in found.items() if x == 0.0} == free
    assert {p for p, x in found.items() if x == packing.SENTENCE} == sentences
    known = sorted(free | sentences)
    dear = {p for a, b in zip(known, known[1:], strict=False) if b - a > 4 * packing.GRAIN for p in range(a + packing.GRAIN, b, packing.GRAIN)}
    assert dear and {p for p, x in found.items() if x == packing.TRUNCATION} == dear


def test_pieces_are_encoded_in_few_calls(monkeypatch):
    """One special token among many pieces had thousands of them encoded singly."""
    import pyarrow as pa

    from lorehouse.llm.tokens import PieceEncoder

    encode, calls = PieceEncoder(), []
    ids = encode._ids
    monkeypatch.setattr(encode, "_ids", lambda text: calls.append(1) or ids(text))
    letters = "abcdefghijklmnopqrst"
    pieces = [a + b + c + "q" for a in letters for b in letters for c in letters]
    encode(pa.array([" ".join(pieces)]))
    assert len(calls) == 1
    calls.clear()
    odd = [p + "z" for p in pieces] + ["<|endoftext|>x", "á́b", "①"]
    flat, _ = encode(pa.array([" ".join(odd)]))
    assert len(calls) < 600
    single = [n for p in odd for n in encode.tokenizer.encode(p, add_special_tokens=False).ids]
    assert flat[:-1].tolist() == single
