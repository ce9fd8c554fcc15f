"""Readers, selection, files and the stream on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docnav.sources import datasets as D
from docnav.sources import files as W
from docnav.sources import selection as S
from docnav.streaming.incremental import score_folder


def test_mmlongbench_rows(spark, tmp_path):
    rows = [("x.pdf", "Report", "q1", "a", "[1, 3]", "['Chart', 'Table']", "Str"), ("x.pdf", "Other", "q2", "b", "[]", "[]", "None")]
    path = str(tmp_path / "m")
    spark.createDataFrame(rows, "doc_id string, doc_type string, question string, answer string, evidence_pages string, evidence_sources string, answer_format string").coalesce(1).write.parquet(path)
    got = D.load(spark, "mmlongbench_doc", path, "train")["questions"].orderBy("qa_id").collect()
    assert [(r.qa_id, r.doc_type, r.evidence_pages, r.evidence_sources) for r in got] == [(0, "Report", [0, 2], ["Chart", "Table"]), (1, "Report", [], [])]
    questions = D.load(spark, "mmlongbench_doc", path, "train")["questions"]
    specs = D.to_run_specs(questions, per_document=1).collect()
    assert [(s.run_id, s.gold.evidence_pages) for s in specs] == [("train_x_q00", [1, 3])]
    samples = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, run_id string, doc_id string, question string, why_chosen string")
    named = lambda chosen: {s.qa_id: (s.run_id, s.why_chosen) for s in D.to_run_specs(questions, chosen=chosen).collect()}
    assert named(samples(("one", "x.pdf", "q2", "w"), ("all", "x.pdf", None, ""))) == {0: ("all_q00", ""), 1: ("one", "w")}
    assert named(samples(("all", "x.pdf", None, ""), ("one", "x.pdf", "q2", "w"))) == {0: ("all_q00", ""), 1: ("all_q01", "")} and named(samples(("n", "x.pdf", "other", ""))) == {}
    assert [len(r.qas) for r in D.documents(D.load(spark, "mmlongbench_doc", path, "train")["questions"]).collect()] == [2]
    with pytest.raises(ValueError, match="splits"):
        D.load(spark, "mmlongbench_doc", path, "test")


def test_mpdocvqa_records(spark, tmp_path):
    rec = {"question_id": 1, "question": "q", "image_id": "d", "image_name": ["p0", "p1"], "answer_page_idx": 1, "answers": ["a", "b", "a"], "ocr_tokens": [["t"], []], "ocr_normalized_boxes": [[(0.0, 0.1, 0.2, 0.3)], []]}
    test = {k: v for k, v in rec.items() if k not in ("answers", "answer_page_idx")} | {"question_id": 2}
    np.save(tmp_path / "imdb_val.npy", np.array([{"header": 1}, rec, test], dtype=object), allow_pickle=True)
    got = D.load(spark, "mpdocvqa", str(tmp_path), "val")
    q = {r.qa_id: r for r in got["questions"].collect()}
    assert (q[1].answer, q[1].alternatives, q[1].evidence_pages) == ("a", ["b"], [1]) and (q[2].answer, q[2].alternatives, q[2].evidence_pages) == (None, [], [])
    pages = {r.page: r for r in got["pages"].collect()}
    assert pages[0].words[0].text == "t" and pages[1].words is None and pages[1].sample_id == "d#1"
    with pytest.raises(D.MissingData):
        D.load(spark, "mpdocvqa", str(tmp_path / "no"), "val")


def test_slidevqa_decks(spark):
    rows = [(0, "deck", "i1", "i2", None, "i4", 7, "q", "a", "None", [1, 2])]
    df = spark.createDataFrame(rows, "ord int, deck_name string, page_1 string, page_2 string, page_3 string, page_4 string, qa_id int, question string, answer string, arithmetic_expression string, evidence_pages array<int>")
    box = lambda i: json.dumps({"deck_name": "deck", "bboxes": [[2, [{"bbox_id": i, "class": "Title", "bbox": [1, 2, 3, 4]}]]]})
    boxes = D.parse_boxes(spark.createDataFrame([(0, box(1)), (1, ""), (2, box(5).replace("Title", "Figure"))], "ord int, value string"))
    got = D.parse_slidevqa(df, boxes)
    assert [(r.page, r.image, r.objects and r.objects[0].label_name) for r in got["pages"].orderBy("page").collect()] == [(0, "i1", None), (1, "i2", "Figure")]
    q = got["questions"].first()
    assert q.arithmetic_expression is None and q.evidence_pages == [0, 1]


def test_remote_parsing_keeps_errors_as_rows(spark):
    def client():
        def parse(content):
            if content == b"bad":
                raise PermissionError("no")
            return [(1, content.decode(), 0, 1)]

        return parse

    got = D.parse_remote(spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "doc_id string, content binary"), client).orderBy("doc_id").collect()
    assert (got[0].page, got[0].md, got[0].pictures) == (1, "ok", 1) and got[1].error == "PermissionError: no"


def test_page_files_and_fallback(spark, tmp_path):
    (tmp_path / "x" / "pages").mkdir(parents=True)
    for n, t in ((1, "# one"), (2, "  ")):
        (tmp_path / "x" / "pages" / f"page_{n:03d}.md").write_text(t)
    got = W.page_files(spark, f"{tmp_path}/x/pages/*.md")
    native = spark.createDataFrame([("x", 1, "n1"), ("x", 2, "n2"), ("x", 3, "n3")], "doc_id string, page int, text string")
    assert [r.text for r in W.with_fallback(got, native).orderBy("page").collect()] == ["# one", "n2", "n3"]


def test_structured_captions(spark):
    item = "array<struct<captions: array<string>, pages: array<int>>>"
    df = spark.createDataFrame([("d", [(["Table 1", "x"], [3, 2]), ([], [1]), (["y"], [])], [(["Fig"], [2])])], f"doc_id string, tables {item}, pictures {item}")
    assert [(r.page, r.s_figures, r.s_tables) for r in W.structured_captions(df).collect()] == [(2, ["Fig"], ["Table 1 x"])]


def test_results_with_old_and_failed_rows(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"run_id": "b", "score_official_rule": 0.0}\n{"run_id": "c", "error": "x"}\n')
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "a", "score": 1.0, "score_official_rule": 0.5}, indent=1))
    assert [(r.run_id, r.score) for r in W.read_results(spark, f"{tmp_path}/r.jsonl", f"{tmp_path}/a.json").collect()] == [("a", 1.0), ("b", 0.0)]


def test_manifest_names_and_report(spark):
    runs = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "run_id string, ord int")
    assert [r.run_id for r in W.manifest(runs, 5).collect()] == ["b", "a"]
    assert W.batch_name("My set", "2024-01-01", {"My-set_2024-01-01"}) == "My-set_2024-01-01_2"
    assert "&lt;b&gt;" in W.html_report(spark.createDataFrame([(0, "<b>")], "ord int, q string"), "t")


def test_sample_sets(spark, tmp_path):
    path = tmp_path / "mini.json"
    path.write_text(json.dumps({"dataset": "mmlongbench_doc", "samples": [{"doc_id": "x.pdf", "question": "q", "run_id": "a"}, {"doc_id": "y.pdf"}, {"doc_id": "x.pdf", "question": "r"}], "author": "n"}))
    for value in (str(path), "mini"):
        s = S.select(spark, value, str(tmp_path))
        assert [r.doc_id for r in S.documents_of(s).orderBy("ord").collect()] == ["x.pdf", "y.pdf"]
        assert [tuple(r) for r in s.samples.orderBy("ord").collect()] == [(0, "a", "x.pdf", "q", ""), (1, "sample02", "y.pdf", None, ""), (2, "sample03", "x.pdf", "r", "")]
        assert (s.name, s.dataset, s.extra, s.label, str(s)) == ("mini", "mmlongbench_doc", {"author": "n"}, "mini", "sample set mini: 3 samples of 2 documents")
    assert [r.question for r in S.questions_of(s, "x.pdf").collect()] == ["q", "r"]
    assert S.select(spark, None).label == "full" and S.select(spark, "3").first == S.select(spark, 3).first == 3 and str(S.select(spark, 2)) == "first 2 documents"
    for bad in ("0", -1):
        with pytest.raises(ValueError, match="positive"):
            S.select(spark, bad)
    for n, bad in enumerate(({"name": "n", "samples": []}, {"name": "n"}, {"samples": [{"doc_id": "a"}, {}]})):
        (tmp_path / f"bad{n}.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="sample"):
            S.select(spark, f"bad{n}", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        S.select(spark, "nowhere", str(tmp_path))
    docs, unknown = S.explicit(spark.createDataFrame([("x.pdf",), ("z.pdf",)], "doc_id string"), s)
    assert [r.doc_id for r in docs.collect()] == ["x.pdf"] and [r.doc_id for r in unknown.collect()] == ["y.pdf"]
    rows = spark.createDataFrame([("y.pdf", 5), ("z.pdf", 1), ("x.pdf", 2), ("z.pdf", 7)], "doc_id string, ord int")
    kept = lambda c: sorted(r.doc_id for r in S.restrict(rows, c, "mmlongbench_doc").collect())
    assert kept(s) == ["x.pdf", "y.pdf"] and kept(S.select(spark, 1)) == ["z.pdf", "z.pdf"] and len(kept(S.select(spark, None))) == 4
    with pytest.raises(ValueError, match="read by documents"):
        S.restrict(rows, S.Selection(samples=s.samples, name="p"), "slidevqa")
    with pytest.raises(ValueError, match="belongs to"):
        S.restrict(rows, S.Selection(samples=s.samples, name="p", dataset="slidevqa"), "mmlongbench_doc")
    numbers = spark.range(10).withColumnRenamed("id", "ord")
    assert [r.ord for r in S.at_places(numbers, -2, None).collect()] == [8] and sorted(r.ord for r in S.at_places(numbers, 3, -4).collect()) == [3, 4, 5]
    settings = spark.createDataFrame([("api_key", "x"), ("judge_api_key", "y"), ("max_rounds", "2")], "key string, value string")
    assert [r.key for r in S.public_settings(settings).collect()] == ["max_rounds"]
    rows = spark.range(100)
    assert S.random_sample(rows, "id", 5).collect() == S.random_sample(rows.repartition(7), "id", 5).collect()


def test_answers_are_scored_once_as_they_arrive(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def arrive(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("run_id", "gold", "format", "response"), r, strict=True))) + "\n" for r in rows))
        score_folder(spark, src, out, ck).awaitTermination()

    arrive("1.json", ("a", "51%", "Float", "The answer is: 0.51"), ("b", "x", "Str", "y"))
    arrive("2.json", ("a", "51%", "Float", "again"), ("c", "3", "Int", "3.7"), ("d", "['a', 'b']", "List", "b and a"))
    assert {r.run_id: r.score for r in spark.read.parquet(out).collect()} == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 1.0}


def test_parsed_pages_are_written_once(spark, tmp_path):
    path = str(tmp_path / "p")
    pages = spark.createDataFrame([("a", 1, "x", "train"), ("b", 1, "y", "val")], "doc_id string, page int, md string, split string")
    W.write_pages(pages.where("doc_id = 'a'"), path)
    W.write_pages(pages, path, spark.read.parquet(path))
    assert spark.read.parquet(path).groupBy("doc_id").count().where(F.col("count") > 1).count() == 0


def test_batches_are_found_and_collected(spark, tmp_path):
    for batch in ("old", "new"):
        for run, score in (("r1", {"score": 0.5}), ("r2", {"score_official_rule": 1.0})):
            for step, name, data in (("00_input", "question.json", {"run_id": run, "doc_id": "d", "question": f"q {run}", "gold": {"answer": "a", "evidence_pages": [1]}}), ("06_evaluation", "result.json", {"run_id": run, **score})):
                (tmp_path / batch / run / step).mkdir(parents=True, exist_ok=True)
                (tmp_path / batch / run / step / name).write_text(json.dumps(data, indent=1))
        (tmp_path / batch / "manifest.json").write_text(json.dumps({"runs": [{"run_id": r} for r in ("r2", "r1", "r2", "gone")]}))
    import os

    os.utime(tmp_path / "old" / "manifest.json", (1, 1))
    found = W.newest_batch(spark, f"file://{tmp_path}")
    assert found.endswith("/new") and W.newest_batch(spark, found).endswith("/new") and W.newest_batch(spark, f"file://{tmp_path}/new/r1") == f"file://{tmp_path}/new/r1"
    assert [(r.run_id, r.question, r.gold.evidence_pages) for r in W.batch_questions(spark, found).collect()] == [("r1", "q r1", [1]), ("r2", "q r2", [1])]
    assert {r.run_id: r.score for r in W.batch_scores(spark, found).collect()} == {"r1": 0.5, "r2": 1.0}
    assert [r.run_id for r in W.discovered_runs(spark, found).collect()] == ["r2", "r1"]
    got = {r.run_id: r.artefacts for r in W.collected(spark, found).collect()}
    assert set(got) == {"r1", "r2"} and set(got["r1"]) == {"00_input/question.json", "06_evaluation/result.json"}


def test_manifest_entries(spark):
    rows = spark.createDataFrame([("a", "d", "q", 1.0, "rules", 1.0, "x", None), ("b", "d", "q", None, None, None, None, "E")], "run_id string, doc_id string, question string, score double, score_source string, score_official_rule double, raw_system_answer string, error string")
    assert [(r.status, r.score_rules, r.error) for r in W.run_entries(rows).orderBy("run_id").collect()] == [("ok", 1.0, None), ("failed", None, "E")]


def test_folders_appear_when_they_are_complete(spark, tmp_path):
    import tarfile

    def fail(folder):
        (tmp_path / ".x.tmp" / "half").write_text("")
        raise OSError

    with pytest.raises(OSError):
        W.publish(str(tmp_path / "x"), fail)
    assert not (tmp_path / "x").exists()
    (tmp_path / "f").write_text("hello")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "f", "in/f")
    assert W.extract_archive(str(tmp_path / "a.tar.gz"), str(tmp_path / "x")) and (tmp_path / "x" / "in" / "f").read_text() == "hello" and not (tmp_path / "x" / "half").exists()
    assert not W.extract_archive(str(tmp_path / "a.tar.gz"), str(tmp_path / "x"))
    pages = spark.createDataFrame([("d1", 0, b"a"), ("d1", 1, b"b"), ("d2", 0, b"c"), ("d2", 1, None)], "doc_id string, page int, image binary")
    assert sorted(map(tuple, W.export_images(pages, str(tmp_path / "img")).collect())) == [("d1", 2), ("d2", 1)]
    assert (tmp_path / "img" / "d1" / "1.png").read_bytes() == b"b"


def test_documents_with_a_failed_page_are_set_aside(spark):
    parsed = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", None), ("b", 2, None, "boom")], "doc_id string, page int, md string, error string")
    good, bad = D.whole_documents(parsed)
    assert [r.doc_id for r in good.collect()] == ["a"] and [tuple(r) for r in bad.collect()] == [("b", 1, "boom")]
    items = spark.createDataFrame([("a", "table", [3, 2]), ("a", "picture", [2]), ("a", "table", [])], "doc_id string, kind string, pages array<int>")
    assert [tuple(r) for r in D.page_counts(items).collect()] == [("a", 2, 1, 1)]
    listed = spark.createDataFrame([("file:/x/pdfs/a",)], "path string")
    assert [r.doc_id for r in D.missing_files(parsed.select("doc_id").distinct(), listed).collect()] == ["b"]


def test_errors_of_the_caller_are_not_tried_again(spark, tmp_path):
    log = tmp_path / "calls"

    def client():
        class Refused(Exception):
            status_code = 422

        def parse(content):
            with open(log, "a") as f:
                f.write("x")
            raise Refused("bad file")

        return parse

    got = D.parse_remote(spark.createDataFrame([("a", b"x")], "doc_id string, content binary"), client).collect()
    assert got[0].error == "Refused: bad file" and log.read_text() == "x"


def test_pages_that_cannot_be_rendered_are_null(spark):
    def render(content, page, side):
        if page == 2:
            raise ValueError
        return content + bytes([page])

    rows = spark.createDataFrame([("d", b"z", 1), ("d", b"z", 2)], "doc_id string, content binary, page int")
    assert [r.image and bytes(r.image) for r in D.rendered(rows, render).orderBy("page").collect()] == [b"z\x01", None]


def test_markdown_as_html():
    assert W.markdown_html("# A <b>\n\n- **x** `y`\n- z\n| a | b |\n|---|---|\n| 1 | 2 |\ntext") == "<h1>A &lt;b&gt;</h1>\n<ul>\n<li><b>x</b> <code>y</code></li>\n<li>z</li>\n</ul>\n<table>\n<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\n<p>text</p>"
