"""Repeated passages, near duplicates and their parts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorehouse.llm import front_coding, near_duplicates, suffix_dedup
from lorehouse.llm.components import components


def brute_repeats(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) as a counter."""
    low = -(1 << 63)
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: low if r[0] is None else r[0]):
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], low if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < (low if doc_id is None else doc_id):
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out[doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block_bytes", [2000, 1 << 22])
def test_repeats(documents, rows, block_bytes):
    cut = suffix_dedup.remove_repeats(documents, block_bytes)
    assert cut.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", *suffix_dedup._MADE.names]
    found = Counter()
    for r in cut.collect():
        raw = (r.text or "").encode()
        edges = [0, *(x for s in r.spans for x in (s.start, s.end)), len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) == bytes(r.kept)
        found[r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()] += 1
    assert found == brute_repeats(rows)


def test_repeats_of_periodic_texts(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab") for _ in range(9)) * 40 + rng.choice(["", "ab" * 30, "é" * 40])) for k in range(12)]
    rows += [(k, rows[k - 12][1][5:300] + "-" + rows[k - 11][1][7:200]) for k in range(12, 18)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter(tuple(r) for r in suffix_dedup.repeat_digest(frame).collect())
    assert found == brute_repeats(rows)


def test_texts_without_repeats(documents, nothing, spark):
    out = suffix_dedup.without_repeats(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    wide = "é" * 60
    frame = spark.createDataFrame([(1, wide), (2, "a" + wide[:30] + "é"), (3, "xé" + wide)], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame).collect()}
    assert texts[1] == wide and texts[3] == "x"


@pytest.mark.parametrize("seed", range(6))
def test_the_loser_tree_keeps_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    runs, everything = [], []
    for _ in range(int(rng.integers(1, 8))):
        rows = sorted(x.tobytes() for x in rng.integers(97, 99, (int(rng.integers(0, 40)), 6)).astype(np.uint8))
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6)
        decoded = front_coding.decode_rows(front_coding.encode_rows(table), len(rows), 6)
        assert decoded[0] == rows
        runs.append(decoded)
        everything += rows
    out = [(runs[r][0][p], h) for r, p, h in front_coding.merge_runs(runs)]
    assert [x for x, _ in out] == sorted(everything)
    for (a, _), (b, h) in zip(out, out[1:], strict=False):
        assert a[:h] == b[:h] and (h == 6 or a[h] != b[h])


_LOW = str.maketrans({chr(c): chr(c).lower() for c in range(65, 91)})


def multiset(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(_LOW))
    if not words:
        return Counter([("text", text or "")])
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_classes(rows):
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        classes[root(k)].append(doc_id)
    return Counter((d, min((x for x in c if x is not None), default=None), len(c)) for c in classes.values() for d in c)


def test_classes(documents, rows, nothing):
    found = Counter(tuple(r) for r in near_duplicates.class_digest(documents).select("doc_id", "class_id", "class_size").collect())
    assert found == brute_classes(rows)
    kept = near_duplicates.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    want = {c for _, c, _ in brute_classes(rows)}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted((c is not None, c or 0) for c in want)
    assert near_duplicates.class_digest(nothing).count() == 0


def test_star_and_chain_of_edits(spark):
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):  # near the base, not near one another
        edited = list(words)
        for at in rng.sample(range(120), 3):
            edited[at] = f"e{k}x{at}"
        rows.append((k, " ".join(edited)))
    chain = [f"c{k}" for k in range(100)]
    for k in range(60, 90):
        chain[k] = f"d{k}"
        rows.append((k, " ".join(chain)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter(tuple(r) for r in near_duplicates.class_digest(frame).collect())
    assert found == brute_classes(rows)


def test_registers_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(rng.integers(3, 60))
        terms = rng.integers(0, 1 << 62, n).astype(np.uint64)
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        one, other = (near_duplicates.bag_min_hash(np.zeros((w > 0).sum(), int), terms[w > 0], w[w > 0], 1, 1000) for w in (a, b))
        errors.append((one == other).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    alone = {x for x in parent if all(u == v for u, v in edges if x in (u, v))}
    assert found == {x: root(x) for x in parent if x not in alone}
