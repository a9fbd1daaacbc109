"""Chunk rules on hand-worked cases, and what holds for every chunking."""

import json
import random

from lorehouse.operators.chunking import chunk_documents

SCHEMA = "id long, raw_content string, doc_type string, attributes string"


def chunks_of(spark, rows, **limits):
    frame = spark.createDataFrame(
        [(i, text, kind, attributes or "{}") for i, (text, kind, attributes) in enumerate(rows)],
        SCHEMA,
    )
    out = {i: [] for i in range(len(rows))}
    for row in sorted(chunk_documents(frame, **limits).collect()):
        out[row.document_id].append(row.content)
    return [out[i] for i in range(len(rows))]


def random_text(rng):
    pieces = []
    for _ in range(rng.randint(1, 25)):
        roll = rng.random()
        if roll < 0.15:
            pieces.append("#" * rng.randint(1, 6) + " harbour")
        elif roll < 0.25:
            pieces.append("\n".join(f"| r{i} | c |" for i in range(rng.randint(1, 12))))
        elif roll < 0.3:
            pieces.append("y" * rng.randint(1, 130))
        else:
            pieces.append(" ".join("lu" * rng.randint(1, 5) for _ in range(rng.randint(1, 30))))
    return "\n\n".join(pieces)


def test_every_word_stays_and_keeps_its_order(spark):
    """Without overlap the words of the chunks are the words of the text; only unbreakable units exceed the size."""
    rng = random.Random(7)
    kinds = ["generic", "regulation", "instruction", "faq", "meeting_notes", "unheard-of"]
    rows = [(random_text(rng), rng.choice(kinds), None) for _ in range(150)]
    for size in (120, 60):
        for (text, kind, _), chunks in zip(rows, chunks_of(spark, rows, size=size, overlap=0), strict=True):
            assert " ".join(chunks).split() == text.split(), kind
            assert all(c.strip() == c and c for c in chunks)
            if kind in ("generic", "unheard-of"):
                whole = [c for c in chunks if len(c) > size + 2]
                assert all("|" in c or " " not in c for c in whole), whole


def test_overlap_repeats_the_end_of_the_chunk_before(spark):
    rng = random.Random(3)
    rows = [("\n\n".join("lu" * rng.randint(2, 12) for _ in range(30)), "generic", None) for _ in range(20)]
    for (text, _, _), chunks in zip(rows, chunks_of(spark, rows, size=80, overlap=30), strict=True):
        units, at = text.split("\n\n"), 0
        for before, chunk in zip([None, *chunks], chunks, strict=False):
            here = chunk.split("\n\n")
            again = 0
            if before is not None:
                last = before.split("\n\n")
                again = next(k for k in range(len(here), -1, -1) if last[len(last) - k :] == here[:k])
                assert sum(map(len, here[:again])) <= 30
            assert here[again:] == units[at : at + len(here) - again]
            at += len(here) - again
        assert at == len(units)


def test_hand_worked_cases(spark):
    table = "\n".join(f"| buoy {i} | {i} m |" for i in range(40))
    rows = [
        (" \n\t ", "generic", None),
        ("# Berths\nSmall boats.\n\n## Fees\nPaid monthly.", "regulation", None),
        ("### When does it open?\nAt dawn.\n\n### Who has keys?\nThe warden.", "faq", None),
        (f"Before.\n\n{table}\n\nAfter.", "generic", None),
        ("one\n\ntwo\n\nthree", "generic", None),
    ]
    blank, rules, questions, tables, short = chunks_of(spark, rows, size=150, overlap=0)
    assert blank == []
    assert rules == ["# Berths\nSmall boats.", "## Fees\nPaid monthly."]
    assert questions == ["### When does it open?\nAt dawn.", "### Who has keys?\nThe warden."]
    assert tables == ["Before.", table, "After."]
    assert short == ["one\n\ntwo\n\nthree"]


def test_meeting_lists(spark):
    """Lists of the attributes become sections; long ones are split between items."""
    items = [f"item {i} of the list" for i in range(20)]
    rows = [("body", "meeting_notes", json.dumps({"decisions": items})), ("body only", "meeting_notes", None)]
    split, plain = chunks_of(spark, rows, size=120, overlap=0)
    assert len(split) > 1 and plain == ["body only"]
    assert [line[2:] for c in split for line in c.split("\n") if line.startswith("- ")] == items
    assert len({c.split("\n")[0] for c in split}) == 1
