"""Text functions, URL rules, pages, readers, reports and evaluation on small frames."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorehouse.functions import text as X
from lorehouse.operators import evaluation as E
from lorehouse.operators import reports as R
from lorehouse.sources import pages as P
from lorehouse.sources import readers as D
from lorehouse.sources import urls as U


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_topics_and_names(spark):
    texts = ["Цены на пакеты и для школы!", "и в", "", "The cat-dog of a b", "xyz xyz ab abc def ghi"]
    assert column(spark, texts, X.slugify_topic) == ["цены-пакеты-школы", "и-в", "fakt", "cat-dog", "xyz-xyz-abc-def"]
    assert column(spark, ["  Иван\t", " A b "], X.canonical_name) == ["иван", "a b"]


def test_limits(spark):
    assert column(spark, ["abcde" * 2000, "x" * 7, "a" * 15001], X.estimate_tokens) == [2500, 1, 3750]
    head, short = column(spark, ["a" * 12000 + "b" * 4000, "ok"], X.head_tail)
    assert head == "a" * 12000 + "\n…\n" + "b" * 3000 and short == "ok"
    body, short = column(spark, ["c" * 8001, "c" * 8000], X.truncate_body)
    assert body == "c" * 8000 + "\n…[усечено]" and short == "c" * 8000


def model_split(text, limit):
    parts = [""]
    for block in (b.strip() for b in re.split(r"\n\s*\n", text.strip())):
        if not block:
            continue
        if len(block) > limit:
            parts += [block[i : i + limit] for i in range(0, len(block), limit)] + [""]
        elif parts[-1] and len(parts[-1]) + 2 + len(block) <= limit:
            parts[-1] += "\n\n" + block
        else:
            parts.append(block)
    return [p for p in parts if p]


def test_split_message_matches_a_model(spark):
    rng = random.Random(1)
    texts = ["".join("слово"[: rng.randint(1, 5)] * rng.randint(1, 6) + rng.choice(["\n\n", "\n", " \n \n"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    got = column(spark, texts, lambda v: X.split_message(v, 20))
    assert got == [model_split(t, 20) for t in texts]


def test_arguments_and_answers(spark):
    values = ["true", "3", "3.7", "-3.7", '" 12 "', '"1_000"', '"x"', "null", None, "{}", "[1]"]
    assert column(spark, values, lambda v: X.coerce_int(v, 7)) == [7, 3, 3, -3, 12, 1000, 7, 7, 7, 7, 7]
    assert column(spark, ['{"a":1}', "[1]", "x", None], lambda v: X.coerce_json_object(v).isNotNull()) == [True, False, False, False]
    assert column(spark, ["Correct.", "well, PARTIAL,x", "hmm", ""], X.parse_verdict) == ["unknown", "partial", "unknown", "unknown"]
    answers = ["В базе знаний этого нет.", "Уточните вопрос", "Уточню: источник — A", "Да"]
    assert column(spark, answers, X.categorize_answer) == ["refused", "clarification", "answered", "answered"]
    urls = ["https://a.com\nhttps://b.com", "смотри https://a.com", "", "HTTP://x"]
    assert column(spark, urls, X.message_urls) == [["https://a.com", "https://b.com"], None, None, ["HTTP://x"]]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Example.com/Page/?utm_source=x&id=7&UTM_medium=y#frag": "https://example.com/Page?id=7",
        "https://example.com/": "https://example.com",
        " http://EX.com:80/a//?q=a b&z&~=* ": "http://ex.com:80/a?q=a+b&z=&~=%2A",
        "http://a.b/?x=%zz&y=%D0%B0": "http://a.b?x=%25zz&y=%D0%B0",
    }
    once = column(spark, list(cases), U.canonical_url)
    assert once == list(cases.values())
    assert column(spark, once, U.canonical_url) == once


def test_url_policy(spark):
    bad = ["http://169.254.169.254/x", "http://127.0.0.1/", "http://10.0.0.1:8/", "http://[::1]/", "http://[fe80::1]/",
           "ftp://example.com/x", "file:///etc/passwd", "http:///x", "http://224.0.0.1", "http://u@192.168.1.1/"]
    good = ["http://93.184.216.34/", "https://example.com", "http://[2606:4700::1111]/", "http://192.0.0.9/", "http://300.1.1.1/"]
    rows = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.reject_reason for r in U.url_policy(rows).collect()}
    assert all(got[u] for u in bad) and not any(got[u] for u in good)


PAGE = """<!DOCTYPE html><html><head><title>Политика &amp; отпуска</title></head><body><header><nav>Меню</nav></header>
<article><h1>Отпуск</h1><p>28 календарных&nbsp;дней &lt;b&gt; &amp;lt;</p><script>var x = "<p>no</p>";</script></article>
<footer>© 2026</footer></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame(
        [("https://A.b/x/", PAGE), ("https://a.b/y", "<html><nav>only</nav></html>"), ("https://a.b/z/", "<p>text</p>")], "url string, html string"
    )
    good, bad = P.extract_pages(rows)
    pages = {r.source_path: r for r in good.collect()}
    first = pages["https://a.b/x"]
    assert first.title == "Политика & отпуска"
    assert first.text == "Отпуск\n28 календарных\xa0дней <b> &lt;"
    assert pages["https://a.b/z"].title == "https://a.b/z"
    assert [r.source_path for r in bad.collect()] == ["https://a.b/y"]


def test_readers(spark, tmp_path):
    (tmp_path / "a b+c.md").write_text("# Тест\nтекст", encoding="utf-8")
    (tmp_path / "page.html").write_text("<p>Привет</p>", encoding="utf-8")
    (tmp_path / "empty.htm").write_text("<nav>x</nav>", encoding="utf-8")
    (tmp_path / "x.bin").write_text("?")
    entries = [{"file": "a b+c.md", "title": "T", "source_path": "https://x"}]
    (tmp_path / "manifest.json").write_text(json.dumps(entries))
    row = D.read_text_documents(spark, str(tmp_path)).first()
    assert (row.source_path, row.title, row.text, row.source_kind) == (str(tmp_path / "a b+c.md"), "a b+c", "# Тест\nтекст", "file")
    good, bad = D.read_html_documents(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["Привет"] and bad.count() == 1
    corpus = D.read_manifest_corpus(spark, str(tmp_path)).collect()
    assert [(r.source_path, r.title, r.source_kind) for r in corpus] == [("https://x", "T", "url")]
    files = {D_name(r.path): r.reject_reason for r in D.filter_supported(D.list_files(spark, str(tmp_path))).collect()}
    assert files["x.bin"] == "unsupported type" and files["page.html"] is None
    D.write_results(corpus_frame(spark), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def D_name(path):
    return path.rsplit("/", 1)[-1]


def corpus_frame(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")


def test_labelled_set_and_metrics(spark, tmp_path):
    (tmp_path / "eval.json").write_text(json.dumps({
        "documents": {"Doc_A": {"doc_type": "faq", "required": ["topic", "questions"]}, "gone": {"doc_type": "faq"}},
        "questions": [{"q": "x", "expect_docs": ["Doc A", "7"], "in_corpus": True}, {"q": "y", "in_corpus": False}, {"q": "z"}],
    }))
    labels, questions = D.read_labelled_set(spark, str(tmp_path / "eval.json"))
    assert {r.question: r.in_corpus for r in questions.collect()} == {"x": True, "y": False, "z": True}
    docs = spark.createDataFrame(
        [(2, "doc_a", "generic", "{}"), (1, "DOC_A", "faq", '{"topic":"t","questions":[]}')], "id long, title string, doc_type string, attributes string"
    )
    assert E.type_accuracy(labels, docs).first()[0] == 1.0
    assert E.attribute_completeness(labels, docs).first()[0] == 0.5
    assert E.type_accuracy(labels, docs.limit(0)).first()[0] is None
    asked = spark.createDataFrame([(1, ["nope", "7"]), (2, ["Doc A"]), (3, ["x"])], "question_id long, expect_docs array<string>")
    shown = spark.createDataFrame([(1, 7, "q"), (2, 9, "Doc A"), (3, 8, "y")], "question_id long, document_id long, document string")
    assert abs(E.recall_at_k(asked, shown).first()[0] - 2 / 3) < 1e-9
    metrics = spark.createDataFrame([("type_accuracy", 0.95), ("recall_at_4", 0.5)], "metric string, value double")
    verdicts = {r.metric: r.verdict for r in E.threshold_gate(metrics).collect()}
    assert verdicts == {"type_accuracy": "ok", "recall_at_4": "FAIL", "attribute_completeness": "n/a", "graph_accuracy": "n/a", "refusals": "n/a"}
    (tmp_path / "q.json").write_text(json.dumps([{"n": 1, "section": "s", "question": "q", "expected": "e", "out_of_corpus": False}]))
    assert D.read_questions(spark, str(tmp_path / "q.json")).first().n == 1


def test_files_are_dealt_over_few_folders(spark, tmp_path):
    texts = {f"{n}.txt": None if n == 7 else f"line {n}\nüber" for n in range(300)}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(3)
    folders = D.write_files(rows, str(tmp_path / "files"), folders=4)
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["0", "1", "2", "3"] and len(folders) == 4
    read = {r.source_path.rsplit("/", 1)[1]: r.text for r in D.read_text_documents(spark, folders).collect()}
    assert read == {name: (text or "") + "\n" for name, text in texts.items()}
    sets = spark.createDataFrame([(f"{n}.json", f'{{"documents": {{"d{n}": {{"doc_type": "faq"}}}}}}') for n in range(5)], "name string, text string")
    labels, _ = D.read_labelled_set(spark, D.write_files(sets, str(tmp_path / "sets"), folders=2))
    assert sorted(r.title for r in labels.collect()) == [f"d{n}" for n in range(5)]


def test_facts_block_and_costs(spark):
    facts = spark.createDataFrame([("b", "2", None), ("a", "1", None), ("c", "3", datetime(2024, 1, 1))], "topic string, content string, invalid_at timestamp")
    assert tuple(R.facts_block(facts).first()) == ("АКТУАЛЬНЫЕ ФАКТЫ:\n[a]: 1\n[b]: 2", False)
    assert tuple(R.facts_block(facts, 20).first()) == ("АКТУАЛЬНЫЕ ФАКТЫ:\n[a", True)
    assert tuple(R.facts_block(facts.limit(0)).first()) == ("", False)
    usage = ['{"cost":1.5,"model":"m"}', '{"cost":null}', '{"model":"m"}', None]
    messages = spark.createDataFrame(
        [(i, 1, u, datetime(2024, 2, 1 + i)) for i, u in enumerate(usage)], "id long, conversation_id long, usage string, created_at timestamp"
    )
    now = F.lit(datetime(2024, 2, 20)).cast("timestamp")
    assert tuple(R.budget_state(messages, now, 1.5).first()) == (1.5, True)
    later = F.lit(datetime(2024, 3, 1)).cast("timestamp")
    assert tuple(R.budget_state(messages, later).first()) == (0.0, False)
    assert {(r.model, r.cost, r.calls) for r in R.cost_by_model(messages).collect()} == {("m", 1.5, 1), (None, None, 1)}


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The driver held every file of a folder; what is read is what Spark's reader finds."""
    for name in ("a b+c%20.txt", ".x.txt", "_x.txt", "_k=v.txt", "empty.txt", "deep/er/ü.MD", "_tmp/y.txt", "_k=v/z.txt", "bad.txt", "no.bin", "_metadata.txt", "w.txt._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else b"\xff\xfe\n" if name == "bad.txt" else f"{name}\r\n".encode())
    for path in (str(tmp_path), f"file://{tmp_path}", [str(tmp_path), str(tmp_path / "deep"), str(tmp_path)], [str(tmp_path / "deep/er/ü.MD"), str(tmp_path / "_tmp")], str(tmp_path / "d*p")):
        frame = D.read_text_documents(spark, path)
        assert bool(frame.inputFiles()) == (path == str(tmp_path / "d*p"))
        wanted = D._whole_files(spark, path).filter(D.file_suffix(F.col("source_path")).isin(".txt", ".md"))
        pairs = [sorted((r.source_path, bytes(r.b)) for r in f.select("source_path", F.col("text").cast("binary").alias("b")).collect()) for f in (frame, wanted)]
        assert pairs[0] == pairs[1] and pairs[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        D.read_text_documents(spark, str(tmp_path / "none"))
