"""The sink of judgments: each batch once, aborted and orphaned parts never, and the header of a resumed run."""

import json

import pytest
from pyspark.sql import functions as F

from corroborate.sources import batches as B

ROWS = "rubric_id string, rubric_sha256 string, judge_role string, requested_judge_model string, score int, attempt int"
HEADER = {k: k for k in B.HEADER} | {"judge_role": "primary", "requested_judge_model": "m", "batch_size": 8, "expected_rubric_count": 3}


def judged(spark, *rows):
    return spark.createDataFrame([(k, f"sha-{k}", "primary", "m", s, a) for k, s, a in rows], ROWS)


def got(spark, at):
    return sorted((r.rubric_id, r.score, r.attempt) for r in B.read(spark, at, ROWS).collect())


def test_a_batch_counts_once(spark, tmp_path):
    at = str(tmp_path / "j")
    assert got(spark, at) == [] and B.commits(spark, at).count() == 0
    one = judged(spark, ("r1", 1, 1), ("r2", -1, 1), ("r3", None, 1)).repartition(3)
    name = B.append(one, at)
    assert B.append(one.repartition(2).orderBy(F.desc("rubric_id")), at) == name  # a retry, dealt and ordered in another way
    B.append(judged(spark, ("r2", 1, 2)), at, "second")
    B.append(judged(spark, ("r2", 1, 3)), at, "second")  # the name tells, whatever the rows
    assert got(spark, at) == [("r1", 1, 1), ("r2", -1, 1), ("r2", 1, 2), ("r3", None, 1)]
    assert {(r.batch, r.n_rows) for r in B.commits(spark, at).collect()} == {(name, 3), ("second", 1)}
    B.append(one.limit(0), at, "none")
    assert len(got(spark, at)) == 4
    with pytest.raises(ValueError):
        B.append(one, at, "../x")


def test_only_committed_parts_count(spark, tmp_path):
    at = str(tmp_path / "j")
    B.append(judged(spark, ("r1", 1, 1)), at, "a")
    (tmp_path / "j" / "rows" / "b-lost.jsonl").write_text('{"rubric_id":"r9"}\n')  # an attempt whose job died
    w = B._Writer(f"file:{at}", "b")
    message = w.write(iter([__import__("pyarrow").RecordBatch.from_pydict({"value": ['{"rubric_id":"r8"}']})]))
    assert (tmp_path / "j" / "rows" / message.name).exists()
    w.abort([message, None])
    assert not (tmp_path / "j" / "rows" / message.name).exists() and [r[0] for r in got(spark, at)] == ["r1"]
    # two tries of one batch that both ran: the later commit gives way
    late = B._Writer(f"file:{at}", "c")
    m = late.write(iter([__import__("pyarrow").RecordBatch.from_pydict({"value": ['{"rubric_id":"r7"}']})]))
    B.append(judged(spark, ("r2", 0, 1)), at, "c")
    late.commit([m])
    assert [r[0] for r in got(spark, at)] == ["r1", "r2"]


def test_a_failing_task_leaves_no_commit(spark, tmp_path):
    at = str(tmp_path / "j")
    bad = judged(spark, *[(f"r{k}", 1, 1) for k in range(40)]).repartition(4).withColumn("score", F.when(F.col("rubric_id") == "r7", F.raise_error(F.lit("judge broke")).cast("int")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="judge broke"):
        B.append(bad, at, "a")
    assert got(spark, at) == []
    B.append(judged(spark, ("r1", 1, 1)), at, "a")
    assert got(spark, at) == [("r1", 1, 1)]


def test_headers_and_what_is_left_to_judge(spark, tmp_path):
    at = str(tmp_path / "j")
    assert B.opened(spark, at, HEADER) is False
    with pytest.raises(FileExistsError):
        B.opened(spark, at, HEADER)
    assert B.opened(spark, at, HEADER | {"note": "other keys may differ"}, resume=True) is True
    for key in B.HEADER:
        with pytest.raises(ValueError, match=key):
            B.opened(spark, at, HEADER | {key: "another"}, resume=True)
    with pytest.raises(ValueError, match="lacks"):
        B.opened(spark, str(tmp_path / "k"), {})
    assert set(json.loads((tmp_path / "j" / "header.json").read_text())) == set(B.HEADER)
    specs = spark.createDataFrame([(f"r{k}", f"sha-r{k}") for k in (1, 2, 3)], "rubric_id string, rubric_sha256 string")
    B.append(judged(spark, ("r1", 1, 1), ("r2", -1, 1)), at)
    left = lambda retry: {r.rubric_id for r in B.to_judge(B.read(spark, at, ROWS), specs, HEADER, retry).collect()}
    assert left(False) == {"r3"} and left(True) == {"r2", "r3"}
    for row, message in ((("r4", 1, 1), "unknown rubric"), (("r1", 2, 2), "no valid score"), (("r1", None, 2), "no valid score")):
        with pytest.raises(Exception, match=message):
            B.resumable(judged(spark, row), specs, HEADER).collect()
    with pytest.raises(Exception, match="another model"):
        B.resumable(judged(spark, ("r1", 1, 1)), specs, HEADER | {"requested_judge_model": "x"}).collect()
