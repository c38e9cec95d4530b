import json

import pytest
from pyspark.errors import PySparkException

from corroborate.plans import research
from corroborate.sources import adapters, files


def test_corpus(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": "a", "title": "t", "url": "u", "content": "c"}\n\n{"title": "t2", "url": "u2", "content": "ü"}\n')
    got = files.corpus(spark, str(p))
    assert {(r.id, r.content) for r in got.collect()} == {("a", "c"), ("u2", "ü")}
    assert files.corpus(spark, str(tmp_path / "none.jsonl")).count() == 0
    files.write_jsonl(got, str(tmp_path / "out"))
    assert '"ü"' in "".join(x.read_text() for x in (tmp_path / "out").glob("part*"))


def test_ingest(spark, tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "a_note.MD").write_text("---\nx: 1\n---\n# Head\nbody")
    (tmp_path / "sub" / "b-c.txt").write_text("plain text")
    (tmp_path / "sub" / "empty.txt").write_text(" \n")
    (tmp_path / "sub" / ".git" / "no.md").write_text("no")
    (tmp_path / "image.png").write_bytes(b"x")
    rows = files.ingest(spark, str(tmp_path), max_chars=12)
    assert {(r.id, r.title, r.content) for r in rows.filter("not skipped").collect()} == {("local-a-note-md", "Head", "# Head\nbody"), ("local-sub-b-c-txt", "b c", "plain text")}
    assert files.ingest_summary(rows).first() == (2, 1)


def test_cases(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "Q?", "level": 3}\n{"id": "x", "query": "R"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"prompt": "P"}]}))
    (tmp_path / "c.csv").write_text("key,input\nk1,I\n")
    (tmp_path / "d.jsonl").write_text('{"query": "D", "report_depth": "deep", "expected_format": "json"}\n')
    norm = lambda f: files.normalised_cases(files.cases(spark, str(tmp_path / f)), "b").collect()
    assert [(r.id, r.query) for r in norm("a.jsonl")] == [("case-0001", "Q?"), ("x", "R")] and norm("b.json")[0].query == "P" and norm("c.csv")[0].id == "k1"
    with pytest.raises(PySparkException):
        norm("d.jsonl")
    with pytest.raises(ValueError):
        files.cases(spark, "x.xml")
    assert [r.ord for r in files.window_of(files.cases(spark, str(tmp_path / "a.jsonl")), 1, 5).collect()] == [1]


def test_ir_files_artifacts_and_run_tables(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq1\td3\t0\nq1\td3\t2\n")
    assert {(r.doc_id, r.rel) for r in files.ir_qrels(spark, str(tmp_path / "q.tsv")).collect()} == {("d1", 1), ("d3", 2)}
    (tmp_path / "g.jsonl").write_text('{"type": "config", "manifest": {"manifest_id": "m"}}\n{"type": "case_result", "case_id": "1"}\n')
    config, cases = files.generation(spark, str(tmp_path / "g.jsonl"))
    assert config.count() == 1 and cases.count() == 1
    (tmp_path / "h.jsonl").write_text('{"type": "case_result", "case_id": "1"}\n{"type": "case_result", "case_id": "1"}\n')
    with pytest.raises(PySparkException):
        files.case_results(spark, str(tmp_path / "h.jsonl")).collect()
    assert files.run_table(spark, str(tmp_path / "none")).count() == 0
    tape = spark.createDataFrame([(2, "b"), (1, "a")], "sequence long, kind string").selectExpr("sequence", "kind", "'o' operation", "'r' request", "'x' response", "'{}' metadata")
    files.write_cassette(tape, str(tmp_path / "tape"))
    assert files.cassette(spark, str(tmp_path / "tape")).count() == 2


def test_adapters(spark):
    q = spark.createDataFrame([(1, "citation faithfulness check"), (2, "zzz")], "query_id long, text string")
    top = adapters.mock(spark, q, 1).orderBy("query_id").collect()
    assert top[0].url.endswith("citation-faithfulness") and top[1].url.endswith("supervisor-researcher")
    with pytest.raises(ValueError):
        adapters.build("nope", spark)
    row = spark.sql("select 'Compare the Apache Spark engine and Flink engine for big streaming jobs today' q")
    assert row.select(adapters.wikipedia_candidates(row.q)).first()[0][:2] == ["Apache Spark engine Flink for big streaming jobs", "Apache Spark engine Flink"]


def test_research_ends_with_a_checked_report(spark):
    r = spark.createDataFrame([(1, "How do agents check citation faithfulness", "concise"), (2, "xqzzy", "deep")], "run_id long, query string, depth string")
    report, claims, sources = research.run(spark, r, adapters.build("mock", spark))
    got = {x.report_id: x for x in report.collect()}
    assert got[1].supported_claims > 0 and got[1].answer.startswith("- ") and "[S" in got[1].answer and set(got) == {1, 2}
    assert sources.groupBy("run_id", "source_id").count().filter("count > 1").count() == 0
