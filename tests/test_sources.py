import json

import pytest

from kervan.plans import stages
from kervan.sources import readers, sinks
from kervan.streaming import resume


def test_csv(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('﻿id,question,answer,context,source,data_type,score,split\n1,"s ""x""","a\nb",,law,,7.5,train\n', encoding="utf-8")
    r = readers.read_csv(spark, str(p)).first()
    assert r.question == 's "x"' and r.answer == "a\nb" and r.context is None and r.score == 7.5
    e = readers.as_examples(readers.read_csv(spark, str(p))).first()
    assert e.query_id == "1" and e.context == ""
    p.write_text("id,question\n1,x\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, str(p))


def test_corpus_shapes(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"id": "oricon_anayasa_000001", "text": "x", "metadata": {"source": ""}, "title": "T"}) + "\n\n")
    r = readers.read_corpus(spark, str(p)).first()
    assert (r.chunk_id, r.doc_id, r.source, r.char_len) == ("oricon_anayasa_000001", "oricon_anayasa", "T", 1)
    assert readers.resolve_corpus(spark, corpus=str(p)).count() == 1
    with pytest.raises(ValueError):
        readers.resolve_corpus(spark, corpus=str(p), docs=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.resolve_corpus(spark, corpus=str(tmp_path / "none"))


def test_directory(spark, tmp_path):
    (tmp_path / "b.txt").write_text("kelime " * 100, encoding="utf-8")
    (tmp_path / "a.txt").write_text(" ")
    got = readers.resolve_corpus(spark, docs=str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {"b"} and got[0].chunk_id == "b_b_0"


def test_questions(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps([{"question": "q", "answer": "", "verified_answer": "v", "gold_sources": [{"source_id": "s1"}, {"source_id": ""}]}]))
    r = readers.read_questions(spark, str(p)).first()
    assert (r.query_id, r.answer, r.gold_ids, r.source) == ("custom_0000", "v", ["s1"], "")
    p.write_text(json.dumps([{"_id": "7", "question": "q", "ground_truth": ""}]))
    with pytest.raises(ValueError, match="7"):
        readers.read_questions(spark, str(p))
    with pytest.raises(FileNotFoundError):
        readers.read_questions(spark, str(tmp_path / "none.csv"))
    c = tmp_path / "q.csv"
    c.write_text("query,expected_answer\nx,y\n")
    assert readers.read_questions(spark, str(c)).first().question == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ığ"), ("b", None)], "query_id string, x string")
    assert sinks.save_jsonl(df, str(tmp_path / "o")) == 2
    sinks.append_missing(df.limit(1), str(tmp_path / "p"))
    sinks.append_missing(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    bad = spark.createDataFrame([("a", [1.0]), ("b", None)], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception):
        sinks.save_index(bad, str(tmp_path / "i"), 1)
    sinks.save_metrics(df.limit(1), str(tmp_path / "m.json"), {"limit": 1})
    assert json.loads((tmp_path / "m.json").read_text())["limit"] == 1
    lines = sinks.report_lines(spark.createDataFrame([("m", 0.5), ("n", None)], "metric string, share double")).collect()
    assert lines[0].line.startswith("#" * 12) and lines[1].line.endswith("N/A")


def test_resume_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"query_id": "1"}\n')
    run = lambda: resume.answer_new(spark, str(src), "query_id string", lambda d: d.selectExpr("query_id", "'x' AS predicted"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (src / "b.json").write_text('{"query_id": "2"}\n')
    run()
    run()
    assert sorted(r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_stages():
    run, said = stages.eligible(["base", "graph", "none"], has_graph=False)
    assert [s.name for s in run] == ["base"] and len(said) == 2
