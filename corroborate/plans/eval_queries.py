"""Queries of packing, metrics, judging, run log and replay operators.

Labels stand for the verdicts of two judges, events for run logs, traces and calls, conversations for costs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators import evidence as E
from corroborate.operators import judging as J
from corroborate.operators import metrics as M
from corroborate.operators import packing as P
from corroborate.operators import quantiles as Q
from corroborate.operators import replay as R
from corroborate.operators import runlog as L
from corroborate.operators.retrieval import small
from corroborate.plans import eval_oracles
from corroborate.plans.evidence_queries import hits, keyword_topk
from corroborate.session import table


def _packable(spark, sf_dir):
    rows = hits(spark, sf_dir).select("query_id", F.col("doc_id").alias("source_id"), "content", T.tokens(F.col("ask")).alias("terms"), F.array().cast("array<string>").alias("quotes"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"), "score")
    return P.excerpts(rows, ["query_id", "source_id", "url", "score"], 400, content_key="source_id").select("query_id", "source_id", F.lit("t").alias("title"), "url", F.lit("local_rag").alias("provider"), F.lit(0.75).alias("quality_score"), "score", "excerpt", "relevance", F.lit(False).alias("has_evidence"))


def best_excerpts(spark, sf_dir):
    """Excerpts of each item's keyword hits."""
    return _packable(spark, sf_dir).select("query_id", "source_id", "relevance", F.length("excerpt").alias("n_chars"), T.context_tokens(F.col("excerpt")).alias("tokens"))


def pack_context(spark, sf_dir):
    """What fits in 2500 tokens of each item's hits."""
    return P.pack(_packable(spark, sf_dir), 2500).select("query_id", F.array_join("kept_source_ids", ",").alias("kept"), F.array_join("dropped_source_ids", ",").alias("dropped"), "estimated_tokens")


def _cases(spark, sf_dir):
    """Labelled documents as case records."""
    d = table(spark, sf_dir, "documents").join(small(table(spark, sf_dir, "labels")), "doc_id")
    total = F.pmod("doc_id", F.lit(4))
    supported = F.when(F.col("quality") == 1, total).otherwise(F.greatest(total - 1, F.lit(0)))
    return M.case_metrics(
        d.select(
            F.col("doc_id").alias("case_id"), "lang", F.when(F.pmod("doc_id", F.lit(9)) == 0, "").otherwise(F.col("text")).alias("answer"), total.alias("n_claims"), total.alias("total_claims"), supported.alias("supported_claims"), (total - supported).alias("unsupported_claims"),
            (F.pmod("doc_id", F.lit(5)) != 0).alias("all_cited"), (F.pmod("doc_id", F.lit(10)) / 10).alias("mean_quality"), F.when(total > 0, supported / total).otherwise(0.0).alias("retention"), F.pmod("doc_id", F.lit(3)).alias("n_sources"), F.pmod("doc_id", F.lit(2)).alias("fallbacks"),
            (F.pmod("doc_id", F.lit(6)) == 0).alias("failure_case"), F.lit("markdown").alias("format"), F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "correct").otherwise("not_attempted").alias("verdict"),
            (F.col("n_chars") * 1.0).alias("latency_ms"), T.cost_tokens(F.col("text")).alias("tokens"), (F.col("n_chars") / 1e6).alias("cost"),
        )
    )


def case_metrics(spark, sf_dir):
    """The flags of each case."""
    return _cases(spark, sf_dir).select("case_id", "task_format_valid", "substantive_answer", "grounded_answer", "evidence_abstention", "final_result_usable", "unsupported_claim_rate", "source_quality", "legacy_success", "tool_failure_recovery")


def eval_summary(spark, sf_dir):
    """A2, A3, A4: summaries by language."""
    return M.evaluation_summary(_cases(spark, sf_dir), ["lang"])


def latency_percentiles(spark, sf_dir):
    """A4: exact percentiles of event values by type."""
    e = table(spark, sf_dir, "events")
    told = Q.with_percentiles(e.groupBy("event_type").agg(F.max("value").alias("max")), e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9})
    return told.select("event_type", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "max")


def cost_rollup(spark, sf_dir):
    """Token costs by conversation, role and model, as a rollup."""
    c = table(spark, sf_dir, "conversations").withColumns(M.record_cost(F.col("text"), F.concat("role", "text"), 0.14, 0.28))
    r = c.select(F.pmod("conv_id", F.lit(10)).alias("run_id"), F.col("role").alias("stage"), F.when(F.pmod("turn", F.lit(2)) == 0, "m0").otherwise("m1").alias("model"), "input_tokens", "output_tokens", "cost", F.lit(0).alias("cache_creation_tokens"), F.lit(1).alias("cache_read_tokens"))
    return M.cost_rollup(r).select("run_id", "stage", "model", F.col("level").cast("int").alias("level"), "total_input_tokens", "total_output_tokens", "total_tokens", F.round("total_cost_usd", 6).alias("total_cost_usd"))


def usage_cost(spark, sf_dir):
    """Usage rows priced; unknown models and missing counts are told apart."""
    e = table(spark, sf_dir, "events")
    u = e.select("event_id", F.concat(F.lit("Model-"), F.pmod("event_id", F.lit(3))).alias("model"), F.pmod("event_id", F.lit(1000)).alias("prompt_tokens"), F.pmod("event_id", F.lit(7)).alias("completion_tokens"), F.pmod("event_id", F.lit(50)).alias("hit_tokens"), F.when(F.pmod("event_id", F.lit(2)) == 0, F.pmod("event_id", F.lit(90))).alias("miss_tokens"))
    prices = spark.createDataFrame([("model-0", 0.01, 0.1, 0.4), ("model-1", 0.02, 0.2, 0.8)], "model string, hit double, miss double, output double")
    return M.usage_cost(u, prices).select("event_id", "error", F.round("cost_usd", 9).alias("cost_usd"))


def crawl_errors(spark, sf_dir):
    """Failures classified, and audits by user."""
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'view')")
    texts = F.array(*[F.lit(x) for x in ("read timed out", "HTTP 429", "status 503", "http 404", "Connection reset by peer", "empty content", "odd")])
    m = e.select("event_id", F.pmod("user_id", F.lit(50)).alias("run_id"), "event_type", F.element_at(texts, (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("message"))
    x = m.withColumn("k", M.crawl_error(F.col("message"))).select("run_id", F.concat(F.when(F.pmod("event_id", F.lit(4)) == 0, "ftp").otherwise("https"), F.lit("://x/"), "event_id").alias("url"), (F.col("event_type") == "view").alias("verified"), F.pmod("event_id", F.lit(3)).alias("crawl_attempts"), F.when(F.col("event_type") == "error", "crawl_failed").otherwise("ok").alias("extract_status"), F.col("k.class").alias("error_class"), F.when(F.pmod("event_id", F.lit(100)) == 0, "v").alias("violation"))
    return M.retrieval_audit(x, ["run_id"]).select("run_id", "candidate_count", "fetchable_count", "verified_count", "crawl_attempts", F.to_json("error_classes").alias("error_classes"), "blocked_count", "denylist_enforcement_hit")


def distributions(spark, sf_dir):
    """Documents by language and source."""
    return M.distributions(table(spark, sf_dir, "documents"), ["lang", "source"])


def answer_judge(spark, sf_dir):
    """Each item's keyword hits as answers; the truth is the item's second word, or, every third item, two groups."""
    top = hits(spark, sf_dir)
    w = F.regexp_replace(F.get(F.split("ask", " "), 1), r"[^\p{L}]", "")
    v = F.regexp_replace(F.get(F.split("ask", " "), 6), r"[^\p{L}]", "")
    json = F.when(F.pmod("query_id", F.lit(3)) == 0, F.concat(F.lit('[["'), w, F.lit('"],["'), v, F.lit('","zzz"]]'))).otherwise(F.concat(F.lit('["'), w, F.lit('"]')))
    return J.judged_answers(top.withColumn("truth", json), "content", "truth").select("query_id", "doc_id", "verdict")


def _judgments(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    side = lambda c, n: l.select(F.col("doc_id").alias("rubric_id"), F.col(c).alias("score"), (F.pmod("doc_id", F.lit(n)) == 0).alias("self_judge"))
    specs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rubric_id"), F.col("lang").alias("category"), F.col("source").alias("case_id"))
    return specs, side("quality", 7), side("toxic", 11)


def dual_judge_merge(spark, sf_dir):
    """Both judges on every document; unlabelled ones are unscored."""
    return J.merge_two(*_judgments(spark, sf_dir), "rubric_id").select("rubric_id", "score_a", "score_b", "agreement", "disagreement", "unscored", "conservative_pass", "independent_pass", "any_self_judge")


def rubric_grouping_sets(spark, sf_dir):
    """Audits in total, by category and by case."""
    return J.audit_rubrics(J.merge_two(*_judgments(spark, sf_dir), "rubric_id")).withColumn("level", F.col("level").cast("int"))


def _verdicts(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    name = lambda c: F.when(F.pmod("doc_id", F.lit(13)) == 0, "unscored").when(F.col(c) == 1, "correct").otherwise("incorrect")
    x = F.explode(F.array(F.struct(F.lit("a").alias("judge"), name("quality").alias("verdict"), (F.pmod("doc_id", F.lit(7)) == 0).alias("self_judge")), F.struct(F.lit("b").alias("judge"), name("toxic").alias("verdict"), F.lit(False).alias("self_judge"))))
    return l.select(F.col("doc_id").alias("case_id"), F.lit("same").alias("answer"), x.alias("x")).select("case_id", "answer", "x.*")


def judge_agreement(spark, sf_dir):
    """Both judges on each labelled case."""
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.lit("same").alias("answer"))
    return J.merge_judges(cases, _verdicts(spark, sf_dir))


def judge_summary(spark, sf_dir):
    """Per judge."""
    return J.judge_summaries(_verdicts(spark, sf_dir))


def rubric_attempts(spark, sf_dir):
    """Latest attempts, what is pending, and its batches."""
    l = table(spark, sf_dir, "labels")
    tries = l.select(F.col("doc_id").alias("rubric_id"), F.explode(F.sequence(F.lit(1), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))).alias("attempt"), "quality")
    last = J.latest(tries.select("rubric_id", "attempt", F.when(F.pmod(F.col("rubric_id") + F.col("attempt"), F.lit(4)) == 0, -1).otherwise(F.col("quality")).alias("score")))
    specs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rubric_id"), F.col("lang").alias("case_id"))
    return J.batches(J.pending(specs, last), "case_id", "rubric_id", 50)


def rubric_specs(spark, sf_dir):
    """A rubric from each sentence of an item."""
    s = T.sentences(F.col("text"))
    specs = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.slice(s, 1, 2).alias("info_recall"), F.slice(s, 2, 1).alias("analysis"), F.slice(s, 3, 1 << 30).alias("presentation"))
    return J.explode_rubrics(specs).select("case_id", "category", "rubric_index", "rubric_id", "rubric_sha256")


def stratified_sample(spark, sf_dir):
    """24 documents, balanced over languages and lengths."""
    size = F.when(F.col("n_chars") < 900, "short").when(F.col("n_chars") < 2500, "middle").otherwise("long")
    return J.stratified(table(spark, sf_dir, "documents").withColumn("size", size), "doc_id", "lang", "size", 24, 7)


def stratum_ranks(spark, sf_dir):
    """W14, the hash ranks: the first three documents of each stratum."""
    w = W.partitionBy("lang", "source").orderBy("h")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", J.stable_rank(7, F.col("source"), F.col("doc_id")).alias("h")).withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("h")


def excluded_candidates(spark, sf_dir):
    """Benchmark items whose normal form no document's first sentence has."""
    q = table(spark, sf_dir, "benchmark").select("item_id", T.normalised_query(F.col("text")).alias("q"))
    d = table(spark, sf_dir, "documents").select(T.normalised_query(F.coalesce(F.get(T.sentences(F.col("text")), 0), F.lit(""))).alias("q"))
    return q.join(d, "q", "left_anti").select("item_id")


def replay_set_diff(spark, sf_dir):
    """Ids that only documents, or only labels, have."""
    return R.id_differences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")), table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.pmod("doc_id", F.lit(50)) == 0, 10**9).otherwise(0)).alias("case_id")))


def contract_check(spark, sf_dir):
    """Drift between documents and a changed copy."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "lang", "source", "n_chars")
    r = d.select("case_id", F.when(F.pmod("case_id", F.lit(9)) == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.pmod("case_id", F.lit(4)) != 0, F.col("source")).alias("source"), (F.col("n_chars") + F.when(F.pmod("case_id", F.lit(8)) == 1, 1).otherwise(0)).alias("n_chars"))
    return R.contract(d, r, ["lang"], ["source", "n_chars"]).select("case_id", F.array_join("drift", ",").alias("drift"))


def _cassette(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") - F.lit(0)).alias("event_id"), F.when(F.col("event_type").isin("view", "click"), "search").otherwise("llm").alias("kind"), F.col("event_type").alias("operation"), F.col("props").alias("request"), F.col("value").cast("string").alias("response"))


def cassette_inventory(spark, sf_dir):
    """Recorded calls by kind."""
    return R.inventory(_cassette(spark, sf_dir))


def cassette_replay(spark, sf_dir):
    """Calls against the recording; every tenth has changed, every seventh is not made."""
    c = _cassette(spark, sf_dir).withColumnRenamed("event_id", "sequence")
    calls = c.filter(F.pmod("sequence", F.lit(7)) != 3).select("sequence", "kind", "operation", F.when(F.pmod("sequence", F.lit(10)) == 0, "{}").otherwise(F.col("request")).alias("request"))
    return R.replayed(c, calls).groupBy("matches", "played").agg(F.count("*").alias("n"))


def case_hashes(spark, sf_dir):
    """Canonical hashes and sealed references of items."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", R.canonical_hash("item_id", "text").alias("sha"), R.opaque_ref(F.col("item_id")).alias("ref"))


def judge_identities(spark, sf_dir):
    """Models of each conversation in the order they appear."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.upper("role").alias("provider"), F.concat(F.lit("m"), F.pmod("turn", F.lit(2))).alias("model"))
    return R.judge_identities(c, "conv_id", "turn")


def _requests(spark, sf_dir):
    """Events as requests on their user's run."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "acquire", "click", "transition", "signup", "heartbeat", "error", "release", "purchase", "complete")]), F.col("event_type"))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), "ts", kind.alias("kind"), F.concat(F.lit("w"), F.pmod("event_id", F.lit(2))).alias("worker"), F.array(F.lit("queued")).alias("expected"), F.lit("running").alias("status"), F.lit(3600).alias("lease_seconds"))


def run_state_fold(spark, sf_dir):
    """The state of each run after all requests."""
    return L.fold(_requests(spark, sf_dir)).select("run_id", "status", "worker", "applied", "rejected", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


def stale_runs(spark, sf_dir):
    """Running runs whose lease is over at the end of the log."""
    end = table(spark, sf_dir, "events").agg(F.max("ts").alias("end"))
    s = L.fold(_requests(spark, sf_dir)).join(F.broadcast(end))
    return L.stale(s, F.col("end")).select("run_id", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("created"), F.max("ts").alias("updated"), F.max_by("event_type", "event_id").alias("last"), F.count("*").alias("n")).select("run_id", "created", "updated", F.when(F.col("last").isin("view", "signup"), "queued").otherwise("running").alias("status"), F.when(F.pmod("n", F.lit(2)) == 0, "planner").otherwise("researcher").alias("stage"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp_ntz").alias("expires"))


def next_queued(spark, sf_dir):
    """The run to take next."""
    return L.next_queued(_runs(spark, sf_dir), F.lit("2030-01-01").cast("timestamp_ntz")).select("run_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


def recent_runs(spark, sf_dir):
    """The twenty runs updated last."""
    return L.recent(_runs(spark, sf_dir), 20).select("run_id", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def event_tail(spark, sf_dir):
    """Events behind the middle one, with payload defaults."""
    p = L.payload_defaults(F.col("props"), F.col("event_type"))
    e = table(spark, sf_dir, "events")
    middle = e.agg(F.floor(F.max("event_id") / 2).alias("m"))
    return e.join(F.broadcast(middle)).filter("event_id > m").select("event_id", p.alias("p")).select("event_id", "p.*")


def trace_totals(spark, sf_dir):
    """Latency and next retry of each run."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("created"), F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k").cast("int")).alias("retries"), F.lit(0).alias("payload_retries"))
    return L.trace_totals(_runs(spark, sf_dir), e).join(L.next_retry(e), "run_id")


def circuit_breaker(spark, sf_dir):
    """Each user's calls through a breaker that opens after two failures for a day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return L.breaker(e, 2, 86400.0)


def rate_limiter(spark, sf_dir):
    """When each call may start at one call an hour and user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return L.limiter(e, 1 / 3600).select("key", "ord", F.round("start", 3).alias("start"))


def otlp_spans(spark, sf_dir):
    """Events as spans."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_type").alias("status"), "ts", F.col("value").alias("duration_ms"))
    return L.otlp_spans(e).select("trace_id", "span_id", "start_ns", "end_ns", "code")


def gold_sources(spark, sf_dir):
    """Per item whether any hit, and any citable hit, is a document that holds it."""
    gold = E.prompt_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), answer_fields=False).select(F.col("item_id").alias("query_id"), "doc_id", F.lit(True).alias("gold"))
    top = keyword_topk(spark, sf_dir).join(gold, ["query_id", "doc_id"], "left").withColumn("citable", F.pmod("doc_id", F.lit(4)) != 0)
    g = top.groupBy("query_id").agg(F.bool_or(F.coalesce("gold", F.lit(False))).alias("retrieved"), F.bool_or(F.coalesce("gold", F.lit(False)) & F.col("citable")).alias("cited"), F.count_if("citable").alias("n_citable"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(g, "query_id", "left")


def event_windows(spark, sf_dir):
    """An extension: events in tumbling days."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_sessions(spark, sf_dir):
    """An extension: sessions of each user, gaps of six hours."""
    s = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        best_excerpts, pack_context, case_metrics, eval_summary, latency_percentiles, cost_rollup, usage_cost, crawl_errors, distributions, answer_judge, dual_judge_merge, rubric_grouping_sets, judge_agreement, judge_summary,
        rubric_attempts, rubric_specs, stratified_sample, stratum_ranks, excluded_candidates, replay_set_diff, contract_check, cassette_inventory, cassette_replay, case_hashes, judge_identities, run_state_fold, stale_runs,
        next_queued, recent_runs, event_tail, trace_totals, circuit_breaker, rate_limiter, otlp_spans, gold_sources, event_windows, event_sessions,
    )
}
ORACLES = eval_oracles.ORACLES
