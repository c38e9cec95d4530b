"""Retrieval, evidence, packing, metrics, judging, run log and replay on small literal tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corroborate.functions import urls as U
from corroborate.operators import evidence as E
from corroborate.operators import judging as J
from corroborate.operators import metrics as M
from corroborate.operators import packing as P
from corroborate.operators import replay as Y
from corroborate.operators import retrieval as X
from corroborate.operators import runlog as L
from corroborate.streaming import runs as S

RANK = "query_id string, doc_id string, rank int"
QREL = "query_id string, doc_id string, rel int"


def metrics(spark, ranking, qrels, k):
    rows = [(q, d, r + 1) for q, ds in ranking.items() for r, d in enumerate(ds)]
    rel = [(q, d, 1) for q, ds in qrels.items() for d in ds]
    return X.mean_metrics(X.ir_metrics(spark.createDataFrame(rows, RANK), spark.createDataFrame(rel, QREL), k)).first()


def test_ir_metrics(spark):
    m = metrics(spark, {"q1": ["d1", "d9"], "q2": ["d8", "d3"]}, {"q1": ["d1", "d2"], "q2": ["d3"]}, 2)
    log3 = math.log2(3)
    assert m.recall == 0.75 and m.mrr == 0.75 and abs(m.ndcg - (1 / (1 + 1 / log3) + 1 / log3) / 2) < 1e-12
    m = metrics(spark, {"q1": ["d1", "d1", "d2"]}, {"q1": ["d1", "d2"]}, 3)
    assert (m.recall, m.ndcg, m.mrr) == (1.0, 1.0, 1.0)
    with pytest.raises(PySparkException):
        metrics(spark, {"q2": ["d1"]}, {"q1": ["d1"]}, 2)


def test_ir_validation(spark):
    c, q = spark.createDataFrame([("d1",)], "doc_id string"), spark.createDataFrame([("q1",)], "query_id string")
    assert X.validate_ir(c, q, spark.createDataFrame([("q1", "d1", 1)], QREL)).first() == (1, 1, 1, 1, 1)
    with pytest.raises(PySparkException):
        X.validate_ir(c, q, spark.createDataFrame([("q1", "d2", 1)], QREL)).collect()


def test_keyword_topk_equals_full_scoring(spark):
    docs = [(i, t) for i, t in enumerate(["alpha beta", "beta gamma beta", "", "delta", "alpha beta gamma", "omega"])]
    asks = [("q1", "alpha beta gamma"), ("q2", "nothing shared"), ("q3", "delta omega"), ("q4", "")]
    got = X.keyword_topk(spark.createDataFrame(asks, "query_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    want = []
    for q, t in asks:
        s = sorted((-(len(set(t.split()) & set(d.split())) + 0.05), i) for i, d in docs)[:4]
        want += [(q, i, -x, r + 1) for r, (x, i) in enumerate(s)]
    assert sorted((r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got) == sorted((q, i, round(x, 6), r) for q, i, x, r in want)


def test_rrf(spark):
    kw = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], RANK)
    vec = spark.createDataFrame([("q", "c", 1), ("q", "b", 2)], RANK)
    ids = lambda **w: [r.doc_id for r in X.rrf(kw, vec, 3, **w).orderBy("rank").collect()]
    assert ids() == ["b", "a", "c"] and ids(vector_weight=4.0) == ["b", "c", "a"]


SOURCE = "url string, title string, content string, provider string, score double, quality_score double, ord int"


def test_dedup_keeps_the_best_and_the_first_among_equals(spark):
    rows = [("https://X.com/A/?q=1", "t", "low", "mock", 1.0, 0.1, 0), ("https://x.com/a", "t", "high", "mock", 1.0, 0.9, 1), ("https://x.com/a#f", "t", "late", "mock", 1.0, 0.9, 2), ("", "Same  Title!", "c", "mock", 1.0, 0.1, 3), (None, "same title", "d", "mock", 2.0, 0.1, 4)]
    got = {r.dedup_key: r.content for r in E.keep_best(spark.createDataFrame(rows, SOURCE)).collect()}
    assert got == {"https://x.com/a": "high", "same title": "d"}


def test_quality(spark):
    rows = [("http://bad.example", "click", "click here to subscribe", "unknown", 1.0, 0.0, 0), ("https://good.org/x", "A title", "long content " * 10 + "[1]", "wikipedia", 1.0, 0.0, 1)]
    got = E.verified(spark.createDataFrame(rows, SOURCE)).collect()
    assert [(r.url, r.quality_score) for r in got] == [("https://good.org/x", 0.95)] and "contains_reference_marker" in got[0].quality_reasons


def test_urls(spark):
    bad = ["ftp://x.com/", "http://user@x.com/", "http://localhost/", "http://127.0.0.1/", "http://10.0.0.1/", "http://169.254.169.254/", "http://x.com:0/", "http://x.com:70000/", "http://x .com/", "//x.com", "", "http://", "http://192.168.1.1/", "http://172.16.0.1/", "http://[::1]/", "http://metadata.google.internal/", "http://x.com/\n", "http://224.0.0.1/"]
    df = spark.createDataFrame([(u,) for u in [*bad, "https://example.com:8443/a?b", None]], "u string")
    got = {r.u: r.v for r in df.select("u", U.valid(F.col("u")).alias("v")).collect()}
    assert [u for u in bad if got[u]] == [] and got["https://example.com:8443/a?b"] and not got[None]
    i = df.select(U.identity(F.lit("HTTPS://Example.COM.:443/Path?q#f"))).first()[0]
    assert tuple(i) == ("https", "example.com", None, "/Path")


def test_denylist(spark):
    s = spark.createDataFrame([(k, u) for k, u in enumerate(["https://a.com/report.html", "https://a.com/report/ch1", "https://a.com/reports/x", "https://b.com/report/ch1", "https://a.com/other?x", "https://github.com/x/simpleqa/y"])], "k int, url string")
    b = spark.createDataFrame([("https://A.com/report.html?utm=1",), ("https://a.com/other",), ("not a url",)], "url string")
    assert {r.k for r in E.denylisted(s, b).filter("blocked").collect()} == {0, 1, 4, 5}


CLAIM = "report_id int, ord int, claim string"
KNOWN = "report_id int, source_id string, title string, content string, extract_status string, snippet_only boolean"


def checked(spark, claims, sources):
    c = spark.createDataFrame([(1, k, x) for k, x in enumerate(claims)], CLAIM)
    s = spark.createDataFrame([(1, *x) for x in sources], KNOWN)
    a = E.assessments(E.citations(c, s))
    return [r.support_level for r in a.orderBy("ord").collect()], E.citation_report(a).first()


def test_citations(spark):
    text = "Solar panels convert sunlight into electricity. They need little care."
    src = [("S1", "Solar", text, "ok", False), ("S2", "Solar", text, "snippet", False)]
    levels, r = checked(spark, ["Solar panels convert sunlight [S1].", "Bananas grow quickly underwater [S1].", "Solar panels [S9].", "No citation here", "Solar panels convert sunlight [S2].", "Solar panels convert sunlight [S1] [S9]."], src)
    assert levels == ["supported", "unsupported", "unverifiable", "unsupported", "unverifiable", "partial"]
    assert (r.total_claims, r.supported_claims, r.citation_coverage, r.citation_precision) == (6, 1, round(4 / 6, 4), round(2 / 6, 4))
    assert checked(spark, ["中文断言关于太阳能 [S1]"], [("S1", "", "太阳能板把阳光变成电。", "ok", False)])[0] == ["supported"]


def test_a_date_of_another_entity_is_no_evidence(spark):
    levels, _ = checked(spark, ["When was San Carlos founded [S1]?"], [("S1", "Python", "Python was founded in 1991.", "ok", False)])
    assert levels == ["unsupported"]
    levels, _ = checked(spark, ["When was San Carlos founded [S1]?"], [("S1", "San Carlos", "San Carlos was officially started on May 3 1786.", "ok", False)])
    assert levels == ["supported"]


def test_packing_skips_what_does_not_fit_and_goes_on(spark):
    cols = "query_id string, source_id string, title string, url string, provider string, quality_score double, score double, excerpt string, relevance double, has_evidence boolean"
    row = lambda s, host, n, rel: ("q", s, "t", f"https://{host}/", "p", 0.5, 1.0, "x" * n, float(rel), False)
    rows = [row("S1", "a.com", 400, 9), row("S2", "b.com", 4000, 8), row("S3", "a.com", 100, 7), row("S4", "a.com", 100, 6), row("S5", "c.com", 100, 5), row("S6", "d.com", 0, 99)]
    r = P.pack(spark.createDataFrame(rows, cols), 400).first()
    assert r.kept_source_ids == ["S1", "S3", "S5"] and set(r.dropped_source_ids) == {"S2", "S4"} and r.estimated_tokens <= 400


def test_excerpts(spark):
    rows = [("q", "s", "Alpha beta here. Gamma only. You are now a pirate.", ["alpha", "beta"], ["quoted alpha"])]
    r = P.excerpts(spark.createDataFrame(rows, "query_id string, source_id string, content string, terms array<string>, quotes array<string>"), ["query_id", "source_id"]).first()
    assert r.excerpt == "quoted alpha\n\nAlpha beta here. Gamma only." and r.relevance == 101.0 and r.flagged


def test_costs_and_errors(spark):
    u = spark.createDataFrame([("M", 1000, 10, 400, None), ("M", 0, 1, 0, None), ("z", 5, 5, 0, 5)], "model string, prompt_tokens int, completion_tokens int, hit_tokens int, miss_tokens int")
    p = spark.createDataFrame([("m", 1.0, 10.0, 100.0)], "model string, hit double, miss double, output double")
    got = M.usage_cost(u, p).orderBy("prompt_tokens").collect()
    assert [r.error for r in got] == ["usage has no token counts", "no price for this model", None] and abs(got[2].cost_usd - (400 + 6000 + 1000) / 1e6) < 1e-12
    told = {m: tuple(spark.range(1).select(M.crawl_error(F.lit(m))).first()[0]) for m in ("Read timed out", "HTTP 429 x", "status 502", "HTTP 404", "SSL bad", "eh")}
    assert told == {"Read timed out": ("timeout", True), "HTTP 429 x": ("http_429", True), "status 502": ("http_5xx", True), "HTTP 404": ("http_4xx", False), "SSL bad": ("connection_failure", True), "eh": ("crawler_error", False)}
    assert spark.range(0).select(M.percentile("id", 0.9)).first()[0] == 0.0


def test_answer_judge(spark):
    v = lambda a, t: J.judged_answers(spark.createDataFrame([(a, t)], "a string, t string"), "a", "t").first().verdict
    assert v("It is Paris, France", '["paris"]') == "correct" and v("Rome", '["paris"]') == "incorrect" and v("", '["x"]') == "not_attempted" and v("x", "") == "unscored"
    assert v("NYC or so", '[["New York","NYC"],["so"]]') == "correct" and v('{"claims": [], "limitations": ["x"]}', '["x"]') == "not_attempted" and v("Paris", "paris") == "correct"


def test_judge_merges_are_strict_or_keep_their_denominator(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, answer string")
    rows = [(1, j, "a", "correct", False) for j in "xy"] + [(2, "x", "b", "correct", False), (2, "y", "b", "incorrect", True)]
    cols = "case_id int, judge string, answer string, verdict string, self_judge boolean"
    got = {r.case_id: r for r in J.merge_judges(cases, spark.createDataFrame(rows, cols)).collect()}
    assert got[1].independent_dual_correct and not got[1].manual_review and got[2].unanimous_verdict is None and got[2].manual_review
    with pytest.raises(PySparkException):
        J.merge_judges(cases, spark.createDataFrame(rows[:3], cols)).collect()
    specs = spark.createDataFrame([(k, "c", "s") for k in range(3)], "rubric_id int, category string, case_id string")
    side = lambda *x: spark.createDataFrame(list(x), "rubric_id int, score int, self_judge boolean")
    m = J.audit_rubrics(J.merge_two(specs, side((0, 1, False), (1, 1, False)), side((0, 1, False), (1, 0, False)), "rubric_id")).filter("level = 3").first()
    assert (m.rubric_count, m.agreement_count, m.disagreement_count, m.unscored_count, m.independent_pass_count) == (3, 1, 1, 1, 1)


def test_contract_of_judgments(spark):
    c = lambda v, s, conf, missing=(), errors=(): spark.range(1).select(J.contract(F.lit(v), F.lit(s).cast("double"), F.lit(conf).cast("double"), F.array(*map(F.lit, missing)), F.array(*map(F.lit, errors)))).first()[0]
    assert c(" Correct ", 1, 0.9) == "correct" and c("correct", 0, 0.9) == "unscored" and c("correct", 1, 0.9, ["x"]) == "unscored" and c("incorrect", 0, 0.5) == "incorrect" and c("maybe", 1, 1) == c("incorrect", 0, 2) == "unscored"


def test_stratified_sample_is_balanced_and_repeatable(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2]) for i in range(120)], "id long, lang string, source string")
    got = J.stratified(rows, "id", "lang", "source", 12, 3).collect()
    assert sorted(r.lang for r in got) == sorted("abc" * 4) and sorted(r.source for r in got) == sorted("xy" * 6) and len({r.id for r in got}) == 12
    assert got == J.stratified(rows.repartition(7), "id", "lang", "source", 12, 3).collect()


def test_rubrics_attempts_and_batches(spark):
    j = spark.createDataFrame([(1, 1, 0), (1, 2, -1), (2, 1, 1)], "rubric_id int, attempt int, score int")
    assert {(r.rubric_id, r.score) for r in J.latest(j).collect()} == {(1, -1), (2, 1)}
    with pytest.raises(PySparkException):
        J.latest(j.unionByName(j)).collect()
    specs = spark.createDataFrame([(1,), (2,), (3,)], "rubric_id int")
    assert {r[0] for r in J.pending(specs, J.latest(j)).collect()} == {1, 3} and {r[0] for r in J.pending(specs, J.latest(j), retry=False).collect()} == {3}


REQUEST = "run_id string, ord int, ts timestamp_ntz, kind string, worker string, expected array<string>, status string, lease_seconds int"
T0 = dt.datetime(2024, 1, 1)


def request(run, n, minute, kind, worker=None, expected=None, status=None):
    return (run, n, T0 + dt.timedelta(minutes=minute), kind, worker, expected, status, 600)


LOG = [
    request("a", 1, 0, "transition", None, ["queued"], "running"), request("a", 2, 1, "acquire", "w1"), request("a", 3, 2, "acquire", "w2"), request("a", 4, 5, "heartbeat", "w1"), request("a", 5, 6, "transition", None, ["queued"], "running"), request("a", 6, 7, "complete", "w1"), request("a", 7, 8, "acquire", "w1"),
    request("b", 1, 0, "transition", None, ["queued"], "running"), request("b", 2, 1, "acquire", "w1"), request("b", 3, 30, "acquire", "w2"), request("b", 4, 31, "release", "w1"),
    request("c", 1, 0, "transition", None, ["queued"], "running"), request("c", 2, 1, "acquire", "w1"), request("c", 3, 5, "recover"), request("c", 4, 40, "recover"),
]


def test_run_log(spark):
    s = {r.run_id: r for r in L.fold(spark.createDataFrame(LOG, REQUEST)).collect()}
    assert (s["a"].status, s["a"].worker, s["a"].applied, s["a"].rejected) == ("succeeded", None, 4, 3)
    assert (s["b"].status, s["b"].worker, s["b"].expires) == ("running", "w2", T0 + dt.timedelta(minutes=40))
    assert (s["c"].status, s["c"].worker, s["c"].rejected) == ("queued", None, 1)
    late = F.lit(T0 + dt.timedelta(hours=2)).cast("timestamp_ntz")
    assert [r.run_id for r in L.stale(L.fold(spark.createDataFrame(LOG, REQUEST)), late).collect()] == ["b"]


def test_run_log_stream(spark, tmp_path):
    cols = REQUEST.replace("timestamp_ntz", "timestamp").replace("expected array<string>", "expected string")
    rows = [(*r[:5], ",".join(r[5] or []), *r[6:]) for r in LOG if r[3] != "recover"]
    spark.createDataFrame(rows, cols).write.json(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(cols).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    q = S.run_states(stream).writeStream.outputMode("update").format("memory").queryName("run_states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    s = {r.run_id: r for r in spark.sql("select * from run_states where not stale").collect()}
    assert (s["a"].status, s["a"].applied, s["a"].rejected) == ("succeeded", 4, 3) and s["b"].worker == "w2" and s["c"].status in ("running", "queued")


def test_event_stream_tail_and_windows(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(minutes=7 * k), k % 2, "view", 1.0) for k in range(20)]
    cols = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, cols).write.json(str(tmp_path / "e"))
    q = S.windows(S.tail(spark, str(tmp_path / "e"), cols)).writeStream.outputMode("complete").format("memory").queryName("event_windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select sum(n) n, sum(total) t, count(*) c from event_windows").first()
    assert (got.n, got.t, got.c) == (20, 20.0, 14)
    assert S.sessions(spark.createDataFrame(rows, cols)).count() == 2
    assert [r.event_id for r in L.tail(spark.createDataFrame(rows, cols), 17).orderBy("event_id").collect()] == [18, 19]


def test_breaker_and_limiter(spark):
    a = spark.createDataFrame([("k", n, float(t), ok) for n, (t, ok) in enumerate([(0, False), (1, False), (2, True), (70, False), (71, True), (72, True)])], "key string, ord int, at double, ok boolean")
    r = L.breaker(a, 2, 60).first()
    assert (r.passed, r.refused, r.open) == (5, 1, False)
    c = spark.createDataFrame([("k", n, t) for n, t in enumerate([0.0, 0.1, 0.2, 5.0])], "key string, ord int, at double")
    assert [r.start for r in L.limiter(c, 2.0).orderBy("ord").collect()] == [0.0, 0.5, 1.0, 5.0]


def test_replay(spark):
    cols = "sequence long, kind string, operation string, request string, response string"
    tape = spark.createDataFrame([(1, "llm", "plan", "a", "x"), (2, "search", "s", "b", "y")], cols)
    assert Y.checked_sequence(tape).count() == 2
    with pytest.raises(PySparkException):
        Y.checked_sequence(tape.filter("sequence = 2")).collect()
    calls = spark.createDataFrame([(1, "llm", "plan", "a")], "sequence long, kind string, operation string, request string")
    assert {(r.sequence, r.response, r.played) for r in Y.replayed(tape, calls).collect()} == {(1, "x", True), (2, None, False)}
    with pytest.raises(PySparkException):
        Y.checked_ids(spark.createDataFrame([("a",), ("a",)], "case_id string")).collect()
    m = spark.range(1).select(Y.redact_settings(F.create_map(F.lit("x_api_key"), F.lit("v"), F.lit("token"), F.lit(""), F.lit("model"), F.lit("m")))).first()[0]
    assert m == {"x_api_key": "<redacted>", "token": "", "model": "m"}
    one = Y.set_hash(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), "k", "k", "v").first()[0]
    assert one == Y.set_hash(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k", "v", "k").first()[0] and len(one) == 16


def test_topk_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.standard_normal(5)]) for k in range(60)] + [(60, None), (61, [0.0] * 5), (62, [1.0, 0.0, 0.0, 0.0, 0.0]), (63, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "doc_id long, embedding array<float>")
    asked = df.filter("doc_id % 4 = 2 or doc_id > 60").withColumnRenamed("doc_id", "query_id")
    rows = lambda d: sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in d.collect())
    unit = {i: np.float32(v) / max(1e-30, np.linalg.norm(np.float32(v))) for i, v in vectors if v}
    want = []
    for q in unit:
        if q % 4 == 2 or q > 60:
            first = sorted((-round(float(unit[q].astype(float) @ v.astype(float)), 6), i) for i, v in unit.items())[:3]
            want += [(q, i) for _, i in first]
    whole = rows(X.vector_topk(asked, df, 3))
    assert sorted((q, i) for q, i, _, _ in whole) == sorted(want)
    texts = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 12, 6))) for k in range(80)], "doc_id long, text string")
    asks = texts.filter("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    words = rows(X.keyword_topk(asks, texts, 4))
    monkeypatch.setattr(X, "BLOCK", 3)
    monkeypatch.setattr(X, "CELLS", 10)
    assert rows(X.vector_topk(asked, df, 3)) == whole and rows(X.keyword_topk(asks, texts, 4)) == words
    assert X.vector_topk(asked.limit(0), df, 3).count() == 0 and X.keyword_topk(asks, texts.limit(0), 3).count() == 0


def test_one_log_gives_the_same_states_in_batch_and_stream(spark, tmp_path):
    cols = REQUEST.replace("timestamp_ntz", "timestamp").replace("expected array<string>", "expected string")
    spark.createDataFrame([(*r[:5], ",".join(r[5] or []), *r[6:]) for r in LOG], cols).write.json(str(tmp_path / "in"))
    q = S.run_states(spark.readStream.schema(cols).json(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("whole_log").trigger(availableNow=True).start()
    q.awaitTermination(120)
    state = lambda rows: {r.run_id: (r.status, r.worker, r.applied, r.rejected) for r in rows}
    # runs whose lease the watermark has passed come once more, as stale; the states of the log itself are those that are not
    assert state(spark.sql("select * from whole_log where not stale").collect()) == state(L.fold(spark.createDataFrame(LOG, REQUEST)).collect())


def test_run_control_by_rules(spark):
    from corroborate.operators import control as C

    logs = {
        "approved": ["plan", "approve", "advance", "finish", "cancel"],
        "edited": ["plan", "edit", "edit", "fail", "retry"],
        "rejected": ["approve", "plan", "reject", "retry"],
        "unplanned": ["fail", "retry", "bogus"],
    }
    rows = [(run, k, T0, c, f"n{k}", f"p{k}", "synthesizer") for run, log in logs.items() for k, c in enumerate(log)]
    df = spark.createDataFrame(rows, "run_id string, ord int, ts timestamp, command string, note string, plan string, stage string")
    runs = C.controlled(df)
    got = {r.run_id: (r.status, r.stage, r.plan, r.error, r.retries, r.told) for r in runs.collect()}
    assert got == {
        "approved": ("succeeded", "completed", "p0", None, 0, ["applied"] * 4 + ["kept"]),
        "edited": ("queued", "researcher", "p1", None, 1, ["applied", "applied", "refused", "applied", "applied"]),
        "rejected": ("cancelled", "completed", "p1", "n2", 0, ["refused", "applied", "applied", "refused"]),
        "unplanned": ("queued", "planner", None, None, 1, ["applied", "applied", "refused"]),
    }
    marks = spark.createDataFrame([("edited", "Q1", 2), ("edited", "Q2", 0), ("approved", "Q1", 1), ("unplanned", "Q1", 1)], "run_id string, q string, evidence int")
    assert {(r.run_id, r.q, r.reused) for r in C.reusable(runs, marks).collect()} == {("edited", "Q1", True), ("edited", "Q2", False)}
    empty = df.limit(0)
    assert C.controlled(empty).count() == 0


def test_numbering_goes_on_over_ranges(spark):
    from corroborate.sources import files

    rows = spark.range(200).selectExpr("id * 3 as ord", "concat('q', id) as question").repartition(7)
    got = {r.query: r.id for r in files.normalised_cases(rows, "b").collect()}
    assert got == {f"q{k}": f"case-{k + 1:04d}" for k in range(200)}


def test_hybrid_search_degrades_with_its_reason(spark):
    kw = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], "query_id string, doc_id string, score double, rank int")
    vec = spark.createDataFrame([("q", "c", 0.9, 1), ("q", "b", 0.8, 2)], "query_id string, doc_id string, score double, rank int")

    def broken():
        raise ValueError("no model")

    low = X.hybrid_sources(kw, broken, 1).collect()
    assert [(r.doc_id, r["rank"], r.metadata["retrieval_degraded"], r.metadata["degrade_reason"]) for r in low] == [("a", 1, "true", "ValueError: no model")]
    both = X.hybrid_sources(kw, lambda: vec, 3).orderBy("rank").collect()
    assert [r.doc_id for r in both] == ["b", "a", "c"] and both[0].metadata["keyword_score"] == "1.0" and both[0].metadata["vector_rank"] == "2" and both[1].metadata["vector_score"] is None


@pytest.mark.parametrize("step", [1, 40_000_000])
def test_label_ranking_is_that_of_all_pairs(spark, monkeypatch, step):
    """Labels of one, a few and many rows, null labels and ids, and ids so far apart that their distances are the same to a double."""
    rng = np.random.default_rng(8)
    labels = [int(x) if x < 6 else None for x in rng.choice(8, 90, p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.03, 0.03, 0.04])] + [9]
    ids = [2 * int(x) * step for x in rng.choice(400, 91, replace=False)]
    corpus = [*zip(ids, labels, strict=True), (None, 1), (None, 0)]
    asked = [*corpus[::3][:30], (ids[-1] - 1, 9), (-5, 1), (7, None), (9, 77)]

    def first(rows):
        out = []
        for q, ql in asked:
            scored = sorted(((ql is not None and ql == x) + 1.0 / (1.0 + abs(d - q)), -d) for d, x in rows if d is not None)
            out += [(q, -d, s, k + 1) for k, (s, d) in enumerate(scored[::-1][:4])]
            out += [(q, None, None, k + 1) for k in range(len(scored[:4]), min(4, len(rows)))]
        return sorted(out, key=str)

    monkeypatch.setattr(X, "NEAR_ROWS", 20)
    q = spark.createDataFrame(asked, "query_id long, label int")
    for rows in (corpus, corpus[-4:]):
        got = X.label_topk(q, spark.createDataFrame(rows, "doc_id long, label int"), 4).collect()
        assert sorted(((r.query_id, r.doc_id, r.score, r["rank"]) for r in got), key=str) == first(rows)


def test_metrics_by_label_are_those_of_pairs(spark):
    corpus = spark.createDataFrame([(d, d % 3 if d < 20 else 7 if d == 20 else None, d % 4) for d in range(24)], "doc_id long, label int, rel int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 7), (4, 8), (5, None), (6, 0)], "query_id long, label int")
    ranking = spark.createDataFrame([(q, (5 * q + 7 * k) % 24, k + 1) for q in range(6) for k in range(8)], "query_id long, doc_id long, rank int")
    pairs = queries.join(corpus, "label")
    rows = lambda m: sorted((r.query_id, round(r.recall, 12), round(r.ndcg, 12), r.rr) for r in m.collect())
    got = X.label_metrics(ranking, queries, corpus, 5)
    assert rows(got) == rows(X.ir_metrics(ranking, pairs.select("query_id", "doc_id", "rel"), 5)) and got.count() == 3
    sizes = X.validate_labels(corpus.select("doc_id", "label"), queries)
    assert sizes.collect() == X.validate_ir(corpus, queries, pairs.select("query_id", "doc_id")).collect()
    assert X.validate_labels(corpus.limit(0).select("doc_id", "label"), queries).first() == (0, 7, 0, 0, 0)


def test_label_rankings_compare_no_pairs(spark, tmp_path):
    from corroborate.plans import evidence_queries as Q

    spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 0.1).cast("array<float>").alias("embedding"), F.pmod("id", F.lit(3)).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert "NestedLoop" not in Q._label_ranking(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
