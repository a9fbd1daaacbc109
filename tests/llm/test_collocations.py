"""Collocations against plain counting, whatever the bounds of the trie; the double array against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lorehouse.llm import collocations, double_array

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=3):
    found, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                found.update(("und" if lang is None else lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return found, total


def expected(rows, least=10, first=2000, longest=3):
    found, total = counted(rows, longest)
    kept = {p: a for p, a in found.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in kept.items():
        cuts = [(lang, words[:k], words[k:]) for k in range(1, len(words))]
        score, _, le, r = min((1000000 * a * a // (found[g, x] * found[g, y]), k, found[g, x], found[g, y]) for k, (g, x, y) in enumerate(cuts))
        covered = any(
            g == lang and len(longer) > len(words) and 100 * b >= 50 * a and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (g, longer), b in kept.items()
        )
        if not covered:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), le, r))
    rows = []
    for lang, some in out.items():
        for rank, (score, a, phrase, le, r) in enumerate(sorted(some)[:first], 1):
            rows.append((lang, rank, phrase.decode(), -a, le, r, total[lang], -score))
    return sorted(rows)


def texts(seed, n):
    rng = random.Random(seed)
    words = "The of and River stone é ü İs x0 \x1c, _ 東 -- a\xa0b".split(" ") + ["same"]
    weights = [30, 20, 15, 9, 8, 5, 4, 3, 3, 2, 2, 2, 2, 2, 2]
    rows = []
    for _ in range(n):
        some = rng.choices(words, weights[: len(words)], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for w in some)
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice([text, text, text, text, None])))
    return rows + [("en", "same " * 400), ("one", None), ("one", " \t.")]


@pytest.mark.parametrize("limits", [{}, {"max_words": 6, "max_phrases": 4}, {"max_phrases": 3}, {"max_words": 3}])
def test_phrases_equal_plain_counting(spark, limits):
    rows = texts(len(limits), 300)
    frame = spark.createDataFrame([(*r, 1, "own") for r in rows], "lang string, text string, words int, phrase string").repartition(4)
    assert sorted(tuple(r) for r in collocations.phrase_digest(frame, **limits).collect()) == expected(rows)


def test_longer_phrases_and_fewer_of_them(spark):
    rows = texts(9, 80)
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    found = collocations.phrase_digest(frame, 5, least=4, longest=4)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 4, 5, 4)


def test_hapaxes_and_totals(spark, documents, rows, nothing):
    found = {(r.lang, r.words, r.phrase): r.f for r in collocations.count_phrases(documents, least=2).collect()}
    plain, total = counted([("en", t) for _, t in rows])
    assert found == {("en", len(p), " ".join(p)): n for (_, p), n in plain.items() if n > 1} | {("en", 0, ""): total["en"]}
    assert collocations.phrase_digest(nothing).count() == 0


@pytest.mark.parametrize("rounds", [60, 1])
def test_double_array(monkeypatch, rounds):
    monkeypatch.setattr(double_array, "ROUNDS", rounds)
    rng = np.random.default_rng(rounds)
    letters, levels = 300, [{}]
    array = double_array.DoubleArray(letters, 9000)
    states = {(c,): c for c in range(letters)}
    for length in (2, 3):
        heads = [p for p in states if len(p) == length - 1]
        hubs = [heads[k] for k in rng.integers(0, len(heads), 20)]
        edges = {(*heads[k], int(c)) for k, c in zip(rng.integers(0, len(heads), 2000), rng.zipf(1.3, 2000) % letters, strict=True)}
        edges |= {(*h, int(c)) for h in hubs for c in rng.integers(0, letters, 120)}
        edges = sorted(edges)
        array.add(np.array([states[e[:-1]] for e in edges]), np.array([e[-1] for e in edges]))
        found = array.step(np.array([states[e[:-1]] for e in edges]), np.array([e[-1] for e in edges]))
        assert (found >= 0).all() and len(set(found.tolist())) == len(edges)
        assert list(zip(*[p.tolist() for p in array.path(found, length)], strict=True)) == edges
        states |= dict(zip(edges, found.tolist(), strict=True))
        levels.append(edges)
    for length in (1, 2, 3):
        known = [p for p in states if len(p) == length]
        some = [known[k] for k in rng.integers(0, len(known), 3000)]
        codes = rng.integers(-1, letters, 3000)
        got = array.step(np.array([states[p] for p in some]), codes)
        assert got.tolist() == [states.get((*p, c), -1) for p, c in zip(some, codes.tolist(), strict=True)]
    assert (array.step(np.full(5, -1), np.arange(5)) == -1).all()
    assert len(array.spilled_keys) or rounds > 1


def test_rows_leave_a_task_in_slices(monkeypatch):
    """Phrases that are not in the trie were named all at once, which took the memory of a whole shard's names."""
    from types import SimpleNamespace

    import pyarrow as pa

    from lorehouse.llm import collocations as C

    monkeypatch.setattr(C, "SLICE", 7)
    text = " ".join(f"w{i % 13}" for i in range(400)) + ". " + " ".join(f"w{i * i % 13}" for i in range(400))
    batch = pa.record_batch([pa.array(["en", "de", "en"]), pa.array([text, text, "w1 w2"])], names=["lang", "text"])
    words = pa.table({"lang": ["de"] * 13 + ["en"] * 13, "phrase": [f"w{i}" for i in range(13)] * 2})
    trie = C.PhraseTrie(words, [words.slice(0, 0)], {1: True})
    out = list(C._count_phrases(SimpleNamespace(value=trie.plain()), 2)(iter([batch])))
    assert max(b.num_rows for b in out) <= 7
    got = {}
    for row in pa.Table.from_batches(out).to_pylist():
        got[row["lang"], row["phrase"]] = got.get((row["lang"], row["phrase"]), 0) + row["f"]
    expected = {}
    for lang, whole in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
        for piece in whole.split("."):
            tokens = piece.split()
            for pair in zip(tokens, tokens[1:], strict=False):
                expected[lang, " ".join(pair)] = expected.get((lang, " ".join(pair)), 0) + 1
    assert got == expected
