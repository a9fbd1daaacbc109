"""Decontamination, fingerprints, toxicity, main text and WARC records."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorehouse.llm import decontamination, fingerprints, main_text, toxicity, warc

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(c): chr(c).lower() for c in range(65, 91)})


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def brute_leaks(rows, items):
    windows = {}
    for item, text in items:
        some = words(text)
        if some:
            for k in range(max(1, len(some) - 9)):
                windows.setdefault(tuple(some[k : k + 10]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc_id, text in rows:
        some, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(some) - size + 1):
                if items_of := windows.get(tuple(some[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= items_of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id, len(some), len(hit), len(found), digest, bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    texts = dict(rows)
    items = [(10, texts[8][20:160]), (9, texts[8][30:170].upper()), (9, texts[9][:120]), (3, "One, two!"), (4, None), (5, "..."), (6, "é " * 11)]
    items += [(None, texts[10][:150]), (7, "aa bb aa bb aa bb aa bb aa bb aa")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("part_bytes", [1 << 24, 500])
def test_leaks(documents, rows, benchmark, part_bytes):
    items, table = benchmark
    found = decontamination.find_leaks(documents, table, part_bytes=part_bytes)
    texts = {t for _, t in rows}
    got = Counter()
    for r in found.collect():
        assert r.text in texts
        raw = (r.text or "").encode()
        assert sum(len(words(raw[h.start : h.end].decode())) for h in r.hits) >= r.n_hit or part_bytes == 500
        got[r.doc_id, r.n_words, r.n_hit, len(r.item_ids), decontamination.sha256_of(r.item_ids), r.n_hit > 0] += 1
    assert got == brute_leaks(rows, items)


def test_leaks_of_odd_tables(documents, rows, benchmark, nothing, spark):
    items, table = benchmark
    kept = decontamination.drop_contaminated(documents, table)
    assert kept.columns == documents.columns
    clean = Counter(r[0] for r in brute_leaks(rows, items).elements() if not r[5])
    assert Counter(r.doc_id for r in kept.collect()) == clean
    assert decontamination.leak_digest(nothing, table).count() == 0
    assert decontamination.leak_digest(documents, table.limit(0)).where("contaminated").count() == 0


def weights(text):
    some = [w for w in re.split(r"[\W_]+", text.lower()) if w] or [text]
    return {w: 1 + math.log(n) for w, n in Counter(some).items()}


def similarity(a, b):
    a, b = weights(a), weights(b)
    every = set(a) | set(b)
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in every) / sum(max(a.get(w, 0), b.get(w, 0)) for w in every)


def test_fingerprints(documents, rows, nothing):
    found = fingerprints.fingerprint_digest(documents).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(found) == len(rows)
    want, errors, by_text = Counter(), [], {}
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    unique = {d: (t or "") for d, t in rows if d is not None and d != 50}
    following = {d: (t2 or "") for (d, _), (_, t2) in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in unique:
            assert by_text.setdefault(unique[r.doc_id], r.fingerprint) == r.fingerprint
            if unique[r.doc_id] == following[r.doc_id]:
                assert r.near_next == 1
            errors.append(r.near_next - similarity(unique[r.doc_id], following[r.doc_id]))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.35
    assert fingerprints.fingerprint_digest(nothing).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of made-up words, some with insults, and their labels."""
    rng = random.Random(4)
    parts = "ba de ki lo mu na pe ri so tu va we zo fa gi hu".split()
    stems = ["grozzel", "blarkin", "snivvard"]
    rows, labels = [], []
    for k in range(900):
        some = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                some.insert(rng.randrange(len(some)), rng.choice(stems) + rng.choice(["", "s", "ed", "ino"]))
        rows.append((k, " ".join(some) + "."))
        labels.append((k, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "?!"), (2003, " ".join(["bade"] * 30000)), (None, "bade kilo"), (5, rows[5][1])]
    rows += [(2004, "bade kilo gro-zz-el muna blarkkin"), (2005, "x" * 400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled, spark):
    documents, labels = labelled
    found = toxicity.toxicity_digest(documents, labels).collect()
    assert len(found) == documents.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in found}
    assert by_id[2004].predicted == 1  # gapped and with a letter too many
    assert not any(by_id[k].predicted for k in (2000, 2001, 2002, 2003, 2005, None))
    kept = toxicity.drop_toxic(documents.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id = 2004").count() == 0


def test_toxicity_without_rows_or_labels(labelled, spark):
    documents, labels = labelled
    assert toxicity.toxicity_digest(documents.limit(0), labels).count() == 0
    few = toxicity.toxicity_digest(documents.limit(20), labels.limit(0)).collect()
    assert len(few) == 20 and all(0 <= r.score <= 1 for r in few)


def slow_kernel(s, t, order, decay):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_the_kernel_counts_subsequences():
    rng = random.Random(0)
    left = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(30)]
    right = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(30)]
    found = toxicity.subsequence_kernel(toxicity.as_codes(left, 0), toxicity.as_codes(right, -1), 3, 0.6)
    assert found == pytest.approx([slow_kernel(a, b, 3, 0.6) for a, b in zip(left, right, strict=True)], rel=1e-4)


PAGES = [
    (1, "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Menu, a</a></li></ul></nav><div class='ad'>Buy, now, here.</div>"
        "<article><h1>Head &amp; more</h1><p><b>First  block,\n with &nbsp;marks.<br>and on<p>Second &#228; block.</p></article>"
        "<footer>&copy; someone, somewhere</footer></body></html>", "Head & more\nFirst block, with marks. and on\nSecond ä block."),
    (2, "<body><div class=header>x, y, z</div><div><div class=content><h2>T</h2><p>One, two, three and a longer paragraph of plain text.</p>"
        "<ul><li>a<li>b</ul></div><div id=comments><p>I, think, that, this, is, a, long, comment</p></div></div><aside>z, z</aside></body>",
        "T\nOne, two, three and a longer paragraph of plain text.\na\nb"),
    (3, None, ""), (4, "", ""), (5, "<nav>only, a, menu</nav><script>var t='<p>no</p>';</script>", ""),
    (6, "<article><p>Cut off in a refer&am", "Cut off in a refer&am"), (7, "<article><p>Cut in a tag</p><p", "Cut in a tag"),
    (8, "plain text, no tags", "plain text, no tags"), (9, "<article><p>" + "word, " * 20000 + "</p></article>", ("word, " * 20000).strip()),
    (10, "<article><form><p>Name, please</p></form><p>Kept &lt;b&gt;.</p><style>p{}</style></article>", "Kept <b>."),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://example.org/{k}", html, "x") for k, html, _ in PAGES] + [(None, None, PAGES[0][1], "y"), (1, "http://example.org/1", PAGES[0][1], "x")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")


def test_main_text(pages):
    found = Counter(tuple(r) for r in main_text.extract_main_text(pages).collect())
    want = Counter((k, f"http://example.org/{k}", t, len(t)) for k, _, t in PAGES)
    want[None, None, PAGES[0][2], len(PAGES[0][2])] += 1
    want[1, "http://example.org/1", PAGES[0][2], len(PAGES[0][2])] += 1
    assert found == want
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


LONG = "A long paragraph, with commas, of plain text that says enough, and a little more, to be the article of its page."
SHORT = "A short closing section."
LINKS = "".join(f"<a href=/{k}>Other story {k}</a> " for k in range(8))
LAYOUTS = [
    # class words that mean something else, inside an article
    (f"<article><p>{LONG}</p><div class='social science'><p>{SHORT}</p></div></article>", [LONG, SHORT]),
    (f"<article><p>{LONG}</p><p class='alert-free share-price'>{SHORT}</p></article>", [LONG, SHORT]),
    (f"<article><p>{LONG}</p><section class='menu-of-the-day'><p>{SHORT}</p></section></article>", [LONG, SHORT]),
    (f"<main><p>{LONG}</p><div id='related-work'><p>{SHORT}</p></div></main>", [LONG, SHORT]),
    (f"<article class='promo hidden-gem'><p>{LONG}</p></article>", [LONG]),
    (f"<article><div class='notice-board history'>{LONG}</div></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class='navigation-at-sea'><p>{SHORT}</p></div></article>", [LONG, SHORT]),
    # ... or do not
    (f"<article><p>{LONG}</p><div class='share-buttons'>Tell a friend about it</div></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class='cookie-banner fixed-bottom dark'>We use cookies, all of them.</div></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class=notice>This site is closing.</div></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class='related-reading'>{LINKS}</div></article>", [LONG]),
    (f"<article><p>{LONG}</p></article><section id=comments><div class='comment byuser odd'><p>{LONG}</p></div></section>", [LONG]),
    (f"<article><p>{LONG}</p><div class='adSlot'>Buy, now.</div></article>", [LONG]),
    (f"<body><div class='site-header'>A name, and a claim</div><div><p>{LONG}</p></div><div class='pageFooter'>Someone, 2020</div></body>", [LONG]),
    # text without article or main
    (f"<div id=wrap><div class=section><p>{LONG}</p></div><div class=section><p>{SHORT}</p></div></div>", [LONG, SHORT]),
    (f"<div id=wrap><div><div><p>{LONG}</p></div></div><div><p>{SHORT}</p></div></div>", [LONG, SHORT]),
    (f"<div><h1>Head</h1><div><p>{LONG}</p></div></div>", ["Head", LONG]),
    (f"<div><div><p>{LONG}</p></div><div>{LINKS}</div></div>", [LONG]),
    (f"<div><div class=sidebar><p>{SHORT}</p></div><div><p>{LONG}</p><p>{SHORT}</p></div></div>", [LONG, SHORT]),
    (f"<div><div class='widget clever'>{SHORT}</div><div><p>{LONG}</p></div></div>", [LONG]),
    (f"<div><div class='social science'><p>{LONG}</p><p>{LONG}</p></div></div>", [LONG, LONG]),
    (f"<table><tr><td>{LINKS}</td><td><p>{LONG}</p><p>{SHORT}</p></td></tr></table>", [LONG, SHORT]),
    (f"<div><h2 class='section-header'>Part</h2><p>{LONG}</p></div>", ["Part", LONG]),
]


@pytest.mark.parametrize("html,want", LAYOUTS)
def test_layouts(html, want):
    assert main_text.main_text(f"<html><body>{html}</body></html>").split("\n") == want


def test_warc_derivatives(pages, spark):
    responses = warc.responses_of(pages)
    folder = warc.write_warc(responses, file_bytes=2000)
    again = warc.read_warc(spark, folder)
    key = lambda r: (r.record_id, r.digest or "")
    assert sorted(map(tuple, responses.select("record_id", "target_uri", "digest", "block").collect()), key=str) == sorted(
        map(tuple, again.select("record_id", "target_uri", "digest", "block").collect()), key=str
    )
    found = warc.derive(again.withColumn("extra", F.lit(1))).collect()
    sources = {r.record_id: r for r in again.collect()}
    assert len(found) == 2 * pages.count()
    for r in sorted(found, key=key):
        source = sources[r.refers_to]
        fields = dict(warc.fields_of(r.header))
        assert fields["WARC-Refers-To"] == source.record_id and fields.get("WARC-Target-URI") == source.target_uri
        assert fields["WARC-Payload-Digest"] == source.digest == r.digest
        sha1 = base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
        assert fields["WARC-Block-Digest"] == f"sha1:{sha1}" and int(fields["Content-Length"]) == len(r.block)
        if r.warc_type == "metadata":
            listed = dict(x.split(": ", 1) for x in bytes(r.block).decode().strip().split("\r\n"))
            assert listed["source-WARC-Record-ID"] == source.record_id and listed["http-status"] == "HTTP/1.1 200 OK"
        else:
            assert "<p" not in bytes(r.block).decode() or "refer" in bytes(r.block).decode()
    assert {r.warc_type for r in found} == {"metadata", "conversion"}
    assert warc.derivative_digest(pages).count() == len(found)
    assert warc.derivative_digest(pages.limit(0)).count() == 0


def test_warc_reads_other_character_sets(spark):
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>été</p>".encode("latin-1")
    rows = [("<urn:1>", "response", "http://x", None, None, None, None, block), ("<urn:2>", "request", "http://x", None, None, None, None, b"GET")]
    rows += [("<urn:3>", "response", None, None, None, None, None, None)]
    found = warc.derive(spark.createDataFrame(rows, warc.RECORD)).where("warc_type = 'conversion'").collect()
    assert {r.refers_to: bytes(r.block).decode() for r in found} == {"<urn:1>": "été", "<urn:3>": ""}


def test_scores_do_not_depend_on_the_batch(labelled):
    documents, labels = labelled
    model = toxicity.fitted(documents, labels)
    texts = [r.text for r in documents.limit(50).collect()]
    together = toxicity.Scorer(model)(pa.array(texts, pa.string()))
    apart = [toxicity.Scorer(model)(pa.array([t], pa.string()))[0] for t in texts]
    assert together == pytest.approx(apart)


def test_words_gapped_by_blanks(labelled):
    assert toxicity.joined("they said i d i o t today".split()) == ["idiot"]
    assert toxicity.joined("be id io t be. so mu".split()) == ["beidiotbe", "somu"]
    assert toxicity.joined("i. d. i - o. t! anyone".split()) == ["idiot"]
    assert toxicity.joined("an i d i o t".split()) == ["anidiot", "idiot"]
    assert toxicity.joined("a bade b kilo".split()) == toxicity.joined([]) == []
    documents, labels = labelled
    score = toxicity.Scorer(toxicity.fitted(documents, labels))
    gapped = [f"bade kilo muna {x} mude kiri" for x in ("g r o z z e l", "bl ar ki n", "s. n. i. v. v. a. r. d", "be g r o z z e l")]
    clean = ["bade kilo muna ba de ki lo mude kiri", "bade kilo muna gr. Oz ze. L mude kiri", "a b c d e f g h " * 3000]
    assert (score(pa.array(gapped, pa.string())) >= toxicity.THRESHOLD).all()
    assert (score(pa.array(clean, pa.string())) < toxicity.THRESHOLD).all()


def test_fitting_holds_words_once():
    """The sample is split text by text, and the machine keeps one copy of its rows."""
    rng = random.Random(3)
    letters = "abcdefghijklmnoprstuvwz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=400) + ["idiot"] * (n % 2)) for n in range(300)]
    tracemalloc.start()
    model = toxicity.fit(texts, [n % 2 for n in range(300)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "^idiot" in model.landmarks
    assert peak < 15 * sum(map(len, texts)), peak
