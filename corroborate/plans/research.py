"""The research pipeline over all questions at once: plan, search, verify, decide, loop, synthesise, check, report.

The loop over rounds is driven from outside; each round is one plan over all open subquestions, whose results are
written to the shared folder. What is closed is left out of the next round by an anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import relevance as R
from corroborate.functions import text as T
from corroborate.operators import evidence as E
from corroborate.session import written

# The deterministic planner's questions, (aspect, question, rationale), concise and deep.
CONCISE = (
    ("scope", "What background and definitions are needed to answer: {}?", "Establish the frame before comparing designs."),
    ("evidence", "What implementation evidence or operational signals matter for: {}?", "Ground the answer in concrete engineering details."),
    ("tradeoffs", "What tradeoffs, risks, and limitations should be considered for: {}?", "Expose the cost of the chosen design instead of presenting it as free."),
    ("evaluation", "How can the claims about {} be evaluated reproducibly?", "Connect the research answer to benchmark and observability signals."),
    ("fallback", "How should fallback behavior be designed for: {}?", "Check reliability and failure handling for agent tools."),
)
DEEP = (
    ("scope", "What background, definitions, scope boundaries, and must-answer items are needed for: {}?", "Define the report's opening section and enumerate every requested deliverable."),
    ("evidence", "What primary evidence, quantitative facts, and source-quality caveats support: {}?", "Build an evidence section from independent, authoritative sources."),
    ("comparison", "Which alternatives, stakeholders, time periods, or cases must be compared for: {}?", "Specify consistent comparison dimensions and collect table-ready evidence."),
    ("analysis", "What causal mechanisms, tradeoffs, disagreements, and limitations shape: {}?", "Create an analysis section that distinguishes evidence from interpretation."),
    ("implications", "What conclusions, implications, and unresolved questions follow from the evidence about: {}?", "Close the report by answering the task directly and identifying genuine evidence gaps."),
)
# The names of actions that end a round or go on, and what a report without evidence says.
STOP_ACTIONS = ["stop", "answer", "complete", "done", "finish", "finished", "skip", "sufficient", "synthesize"]
GO_ACTIONS = ["need_follow_up", "continue_search", "gather_more", "research", "search"]
NO_EVIDENCE = "现有检索结果不足以形成可验证结论。"
Search = Callable[[DataFrame, int], DataFrame]


def plan(requests: DataFrame, researchers: int = 3) -> DataFrame:
    """Requests (run_id, query, depth) as subquestions: run_id, q, question, rationale, search_query, aspects."""
    topic = F.regexp_replace(T.as_question(F.col("query")), r"\?+$", "")
    fill = lambda t: F.concat(F.lit(t.split("{}")[0]), topic, F.lit(t.split("{}")[1]))
    rows = lambda templates, deep: F.array(*[F.struct(F.lit(f"Q{k + 1}").alias("q"), fill(q).alias("question"), F.lit(why).alias("rationale"), F.concat(topic, F.lit(" "), F.lit(why)).alias("search_query"), (F.array(F.lit(a)) if deep else F.array().cast("array<string>")).alias("aspects")) for k, (a, q, why) in enumerate(templates[:researchers])])
    return requests.select("run_id", F.explode(F.when(F.col("depth") == "deep", rows(DEEP, True)).otherwise(rows(CONCISE, False))).alias("s")).select("run_id", "s.*")


def checked_plan(subquestions: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """Per run whether its plan has n questions named Q1 to Qn, each on one of the query's entities where it has two or more."""
    j = subquestions.join(requests.select("run_id", "query"), "run_id")
    anchors = R.query_anchors(F.col("query"))
    on = (F.size(anchors) < 2) | F.arrays_overlap(anchors, T.tokens(F.concat_ws(" ", "question", "search_query")))
    names = F.array(*[F.lit(f"Q{k + 1}") for k in range(n)])
    g = j.withColumn("on", on).groupBy("run_id").agg(F.array_sort(F.collect_set("q")).alias("ids"), F.count("*").alias("n"), F.bool_and("on").alias("on_topic"))
    return g.select("run_id", ((F.col("n") == n) & (F.col("ids") == F.array_sort(names)) & F.col("on_topic")).alias("valid"))


def decide(n_evidence: Column, least: int, question: Column, round_: int) -> Column:
    """struct(action, reason, gap, follow_up) without a model."""
    short = F.lit(least) - n_evidence
    stop = n_evidence >= least
    return F.struct(
        F.when(stop, "stop").otherwise("need_follow_up").alias("action"),
        F.when(stop, "minimum verified evidence coverage reached").otherwise("verified evidence coverage is below the configured minimum").alias("reason"),
        F.when(~stop, F.concat(F.lit("need "), short.cast("string"), F.lit(" additional independent evidence items"))).alias("gap"),
        F.when(~stop, F.concat(question, F.lit(f" independent primary evidence round {round_ + 1}"))).alias("follow_up"),
    )


def decision_of(payload: Column, n_evidence: Column, least: int, question: Column, round_: int) -> Column:
    """The same from a model's JSON: aliases of its fields and actions are understood; stopping short of evidence is refused."""
    p = F.from_json(payload, "map<string,string>")
    wrapped = F.coalesce(*[F.when(F.ltrim(F.try_element_at(p, F.lit(n))).startswith("{"), F.try_element_at(p, F.lit(n))) for n in ("decision", "research_decision", "recommendation")])
    inner = F.from_json(wrapped, "map<string,string>")  # the first of these that is an object; its fields go before those around it
    one = lambda m, n: F.nullif(F.trim(F.try_element_at(m, F.lit(n))), F.lit(""))
    first = lambda *names: F.coalesce(*[x for n in names for x in (one(inner, n), one(p, n))])
    action = F.lower(first("action", "next_action", "decision_type", "status"))
    own = decide(n_evidence, least, question, round_)
    enough = n_evidence >= least
    query = F.coalesce(first("follow_up_query", "next_query", "recommended_search_query", "search_query", "query"), F.concat(question, F.lit(f" independent primary evidence round {round_ + 1}")))
    reason = F.coalesce(first("reason", "rationale", "explanation", "assessment", "summary"), F.lit("model returned a decision without an explanation"))
    told = lambda a, gap, q: F.struct(F.lit(a).alias("action"), reason.alias("reason"), gap.alias("gap"), q.alias("follow_up"))
    none = F.lit(None).cast("string")
    short = F.concat(F.lit("need "), (F.lit(least) - n_evidence).cast("string"), F.lit(" additional evidence items"))
    return F.when(action.isin(STOP_ACTIONS) & enough, told("stop", none, none)).when(action.isin(STOP_ACTIONS), told("need_follow_up", F.coalesce(first("evidence_gap"), short), query)).when(action.isin(GO_ACTIONS), told("need_follow_up", F.coalesce(first("evidence_gap"), F.lit("model requested additional evidence")), query)).otherwise(own)


def one_round(open_: DataFrame, search: Search, k: int, round_: int) -> DataFrame:
    """The verified sources and best quotes of open subquestions (run_id, q, question, search_query)."""
    key = F.concat_ws(":", "run_id", "q")
    asked = open_.withColumn("query_id", key)
    found = search(asked.select("query_id", F.col("search_query").alias("text")), k)
    rows = asked.drop("search_query").join(found, "query_id").withColumn("round", F.lit(round_))
    scored = E.verified(rows)
    quoted = E.best_quotes(scored, ["query_id", "url", "ord"], "question")
    good = E.citable(F.lit("ok"), F.lit(False), F.col("content")) & (F.col("best.score") >= R.min_overlap(F.col("question")))
    return quoted.withColumn("evidence", good).select("run_id", "q", "question", "round", "ord", "title", "url", "content", "provider", "score", "quality_score", F.col("best.quote").alias("quote"), F.col("best.score").alias("overlap"), "evidence")


def research(spark: SparkSession, subquestions: DataFrame, search: Search, rounds: int = 2, least: int = 2, k: int = 3) -> DataFrame:
    """Rounds until each subquestion has enough evidence or no round is left; all rows that were found."""
    open_ = subquestions.select("run_id", "q", "question", "search_query")
    found: DataFrame | None = None
    for n in range(rounds):
        new = written(spark, one_round(open_, search, k * (n + 1), n), "research")
        found = new if found is None else found.unionByName(new)
        have = found.filter("evidence").groupBy("run_id", "q").agg(F.count_distinct("url").alias("n"))
        state = open_.join(have, ["run_id", "q"], "left").withColumn("d", decide(F.coalesce("n", F.lit(0)), least, F.col("question"), n))
        open_ = written(spark, state.filter("d.action <> 'stop'").select("run_id", "q", "question", F.col("d.follow_up").alias("search_query")), "open")
        if open_.isEmpty():
            break
    return found


def canonical(found: DataFrame) -> DataFrame:
    """Each run's distinct sources, the best of each, numbered S1, S2, ..."""
    keyed = found.withColumn("k", F.concat_ws("|", F.col("run_id").cast("string"), E.U.dedup_key(F.col("url"), F.col("title"))))
    order = F.struct(E.worth(), -F.col("round"), -F.col("ord"))
    best = keyed.groupBy("run_id", "k").agg(F.max_by(F.struct("title", "url", "content", "provider", "score", "quality_score", "ord"), order).alias("s")).select("run_id", "k", "s.*")
    return E.numbered(best.withColumn("place", F.concat_ws(":", F.col("ord").cast("string"), "url")), "place", ["run_id"])


def remapped(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence by the ids of the run's canonical sources; rows below the threshold are gone already."""
    k = F.concat_ws("|", F.col("run_id").cast("string"), E.U.dedup_key(F.col("url"), F.col("title")))
    ids = sources.select("k", "source_id")
    return found.filter("evidence").withColumn("k", k).join(ids, "k").groupBy("run_id", "q", "source_id").agg(F.max_by(F.struct("quote", "overlap"), "overlap").alias("b")).select("run_id", "q", "source_id", "b.quote", "b.overlap")


def synthesis(evidence: DataFrame, runs: DataFrame, most: int = 3) -> DataFrame:
    """Per run, claims `quote [id]`: the best evidence of each subquestion, distinct, most at most; (run_id, ord, claim), and a limitation as a claim without citation where there is none."""
    best = evidence.groupBy("run_id", "q").agg(F.max_by(F.struct("quote", "source_id"), F.struct("overlap", "source_id")).alias("b"))
    claims = best.select("run_id", "q", F.concat(T.sanitised(F.col("b.quote"))["text"], F.lit(" ["), "b.source_id", F.lit("]")).alias("claim"))
    g = claims.groupBy("run_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q", "claim"))), lambda x: x["claim"])), 1, most).alias("c"))
    whole = runs.select("run_id").join(g, "run_id", "left").withColumn("c", F.coalesce("c", F.array(F.lit(NO_EVIDENCE))))
    return whole.select("run_id", F.posexplode("c").alias("ord", "claim"))


def retained(assessed: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Per report the supported claims as an answer; none gives the abstention."""
    g = assessed.groupBy("report_id").agg(F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("ord", "claim")))).alias("c"))
    lines = F.array_distinct(F.transform("c", lambda x: x["claim"]))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)) if fmt == "markdown" else lines, "\n")
    return g.select("report_id", F.size(lines).alias("n_claims"), F.when(F.size(lines) > 0, text).otherwise(NO_EVIDENCE).alias("answer"))


def run(spark: SparkSession, requests: DataFrame, search: Search, researchers: int = 3, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, claims, sources) of requests (run_id, query, depth)."""
    found = written(spark, research(spark, plan(requests, researchers), search, rounds), "found")
    sources = written(spark, canonical(found), "sources")
    claims = synthesis(remapped(found, sources), requests).withColumnRenamed("run_id", "report_id")
    known = sources.select(F.col("run_id").alias("report_id"), "source_id", "title", "content", F.lit("ok").alias("extract_status"), F.lit(False).alias("snippet_only"))
    assessed = written(spark, E.assessments(E.citations(claims, known)), "assessed")
    return E.citation_report(assessed).join(retained(assessed), "report_id"), assessed, sources
