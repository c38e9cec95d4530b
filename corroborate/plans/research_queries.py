"""Queries of sources, adapters, parsers and the research pipeline. Benchmark items stand for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import html as H
from corroborate.functions import markdown as D
from corroborate.functions import salvage as G
from corroborate.operators import audit as A
from corroborate.operators import replay as R
from corroborate.operators import runlog as L
from corroborate.plans import research as P
from corroborate.plans.evidence_queries import _queries
from corroborate.plans.text_queries import SQZ, TOK
from corroborate.session import table
from corroborate.sources import adapters as S
from corroborate.sources import files


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), F.col("text").alias("query"), F.when(F.pmod("item_id", F.lit(2)) == 0, "deep").otherwise("concise").alias("depth"))


def html_body_text(spark, sf_dir):
    """The article of each page."""
    return table(spark, sf_dir, "pages").select("page_id", H.body("html").alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("body_md5"))


def html_content(spark, sf_dir):
    """Each page without tags and entities."""
    return table(spark, sf_dir, "pages").select("page_id", H.content("html").alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("content_md5"))


def _answers(spark, sf_dir):
    """Conversation turns as model answers: JSON, fenced JSON, JSON in prose, and prose."""
    t = F.to_json(F.struct(F.col("role"), F.col("text"), F.array("turn").alias("claims")))
    k = F.pmod("conv_id", F.lit(4))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k == 0, t).when(k == 1, F.concat(F.lit("see ```json\n"), t, F.lit("\n```"))).when(k == 2, F.concat(F.lit("well, "), t, F.lit(" so"))).otherwise(F.col("text")).alias("answer"))


def json_salvage(spark, sf_dir):
    """JSON found in answers, and predictions."""
    a = _answers(spark, sf_dir).select("conv_id", "turn", G.object_in("answer").alias("o"), G.json_in("answer").alias("j"), G.predictions_of("answer").alias("p"))
    return a.select("conv_id", "turn", F.get_json_object("o", "$.role").alias("role"), F.col("j").isNotNull().alias("any_json"), F.size(F.from_json("p", "array<string>")).alias("n_predictions"))


def tool_rows(spark, sf_dir):
    """Rows and urls of search tools' answers."""
    p = table(spark, sf_dir, "pages")
    text = F.when(F.pmod("page_id", F.lit(2)) == 0, F.to_json(F.struct(F.array(F.struct("url", F.lit("t").alias("title"))).alias("data")))).otherwise(F.concat(F.lit("Title: t\nURL Source: "), "url", F.lit("\nline one\nline two")))
    r = p.select("page_id", "url", text.alias("t")).select("page_id", "url", G.rows_in("t").alias("r"), G.urls_in("t").alias("u"))
    return r.select("page_id", (F.get("r", 0)["url"] == F.col("url")).alias("same_url"), F.get("r", 0)["title"].alias("title"), F.get("r", 0)["content"].alias("content"), F.size("u").alias("n_urls"))


def _reports(spark, sf_dir):
    """Items as Markdown reports: a heading, a cited and a bare sentence, and a table."""
    t = F.col("text")
    body = F.concat(F.lit("# Key findings\n\n- "), t, F.lit(" [S1]. "), t, F.lit(" bare.\n\nMethod | Result\n--- | ---\n"), t, F.lit(" | x [S2]\nplain | row\n\n## All best results\n"), t, F.lit("\n"))
    return table(spark, sf_dir, "benchmark").select("item_id", body.alias("answer"), t.alias("t"))


def markdown_sanitised(spark, sf_dir):
    """Reports without uncited text."""
    r = _reports(spark, sf_dir).select("item_id", D.sanitised_report("answer", F.lit("")).alias("s"))
    return r.select("item_id", "s.sentences", "s.lines", "s.rows", "s.error", F.length("s.text").alias("n_chars"))


def cited_claims(spark, sf_dir):
    """Claims of reports, and whether the cleaned reports hold nothing else."""
    r = _reports(spark, sf_dir).select("item_id", D.claims_of("answer").alias("c"), "answer", D.sanitised_report("answer", F.lit(""))["text"].alias("clean"))
    return r.select("item_id", F.size("c").alias("n_claims"), D.misalignment("answer", "c", F.lit("")).alias("raw"), D.misalignment("clean", "c", F.lit("")).alias("cleaned"))


def mock_search(spark, sf_dir):
    """The mock adapter's answers."""
    return S.mock(spark, _queries(spark, sf_dir), 3).select("query_id", "ord", "url", F.round("score", 6).alias("score"))


def _landed(spark, sf_dir):
    """Pages as landed results of four providers, three of each an item; items without pages have none."""
    providers = F.array(*[F.lit(x) for x in ("wikipedia", "bing", "gateway-web", "mcp")])
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return p.select(F.floor(F.col("page_id") / 12).alias("query_id"), F.element_at(providers, (F.pmod("page_id", F.lit(4)) + 1).cast("int")).alias("provider"), F.pmod(F.floor(F.col("page_id") / 4), F.lit(3)).cast("int").alias("ord"), title.alias("title"), "url", F.substr(title, F.lit(5), F.lit(40)).alias("content"))


def adapter_scores(spark, sf_dir):
    """Landed results scored by each provider's rule; items without a result fall back."""
    out = None
    for name in ("wikipedia", "bing", "gateway-web", "mcp"):
        r = S.build(name, spark, _landed(spark, sf_dir))(_queries(spark, sf_dir), 3).withColumn("asked", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("asked", "query_id", "ord", "url", "provider", F.round("score", 6).alias("score"))


def query_candidates(spark, sf_dir):
    """What would be asked of two search engines."""
    q = F.concat(F.lit('what is "exact phrase here" at www.Example.com '), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.wikipedia_candidates(F.col("text")), "|").alias("wikipedia"), F.array_join(S.bing_candidates(q), "|").alias("bing"), S.query_domain(q).alias("domain"))


def planned_questions(spark, sf_dir):
    """Subquestions of each request, and whether the plan is valid."""
    r = _requests(spark, sf_dir)
    q = P.plan(r, 3)
    return q.join(P.checked_plan(q, r, 3), "run_id").select("run_id", "q", F.md5("question").alias("question_md5"), F.md5("search_query").alias("search_md5"), F.array_join("aspects", ",").alias("aspects"), "valid")


def decisions(spark, sf_dir):
    """Decisions from models' payloads."""
    c = table(spark, sf_dir, "conversations")
    action = F.element_at(F.array(*[F.lit(x) for x in ("stop", "DONE", "search", "odd", "")]), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    payload = F.when(F.pmod("turn", F.lit(2)) == 0, F.to_json(F.struct(action.alias("next_action"), F.lit("why").alias("rationale")))).otherwise(F.to_json(F.struct(action.alias("action"), F.lit("more").alias("next_query"))))
    k = F.pmod("conv_id", F.lit(3))  # bare, wrapped, and wrapped beside a plain field of another wrapper's name
    payload = F.when(k == 0, payload).when(k == 1, F.concat(F.lit('{"decision": '), payload, F.lit(', "reason": ""}'))).otherwise(F.concat(F.lit('{"decision": "text", "recommendation": '), payload, F.lit("}")))
    return c.select("conv_id", "turn", P.decision_of(payload, F.col("turn"), 2, F.lit("Q"), 0).alias("d")).select("conv_id", "turn", "d.*")


def research_reports(spark, sf_dir):
    """Requests from plan to checked report, with the mock adapter."""
    report, _, _ = P.run(spark, _requests(spark, sf_dir), S.build("mock", spark))
    return report.withColumn("answer_md5", F.md5("answer")).drop("answer")


def run_budgets(spark, sf_dir):
    """Limits of requests."""
    r = _requests(spark, sf_dir)
    one = F.lit(1)
    return r.select("run_id", L.budget(F.col("depth"), one, one, F.when(F.pmod("run_id", F.lit(3)) == 0, 60.0), F.lit(4)).alias("b")).select("run_id", "b.*")


def failed_candidates(spark, sf_dir):
    """Hints of blocked and failed pages."""
    p = table(spark, sf_dir, "pages")
    c = p.select(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url", F.lit("q").alias("query"), F.lit("bing").alias("provider"), F.pmod("page_id", F.lit(10)).alias("rank"), F.when(F.pmod("page_id", F.lit(3)) == 0, "crawl_failed").otherwise("ok").alias("extract_status"), F.when(F.pmod("page_id", F.lit(2)) == 0, "timeout").alias("error_class"), F.lit(None).cast("int").alias("crawl_attempts"), (F.pmod("page_id", F.lit(5)) == 0).alias("blocked"))
    h = A.failed_hints(c)
    return h.select(F.md5("title").alias("title_md5"), "url_identity_sha256", "url", "rank", "crawl_status", "error_class", "crawl_attempts")


def metadata_defaults(spark, sf_dir):
    """sources' metadata with defaults."""
    given = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.create_map(F.lit("extract_status"), F.lit("blocked")))
    d = table(spark, sf_dir, "documents").select("doc_id", A.enriched(given, F.col("text"), F.pmod("doc_id", F.lit(2)) == 0, F.lit("2024-01-01")).alias("m"))
    return d.select("doc_id", *(F.element_at("m", k).alias(k) for k in ("content_hash", "extract_status", "snippet_only")), F.size("m").alias("n"))


def model_probes(spark, sf_dir):
    """Probes, model names and self judgments."""
    e = table(spark, sf_dir, "events")
    actual = F.element_at(F.array(*[F.lit(x) for x in ("m", "m-20240131", "m-20241331", "m-2024011", "other")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    blocks = F.when(F.pmod("event_id", F.lit(3)) == 0, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>"))
    m = F.lit("m")
    return e.select("event_id", A.model_matches(m, actual).alias("matches"), A.probe_status(m, F.when(F.pmod("event_id", F.lit(5)) < 2, actual), F.pmod("event_id", F.lit(2)), F.pmod("event_id", F.lit(4)), blocks).alias("status"), R.self_judged(actual, F.array(m)).alias("self_judge"))


def attempt_ledger(spark, sf_dir):
    """Model calls' attempts by stage and kind."""
    e = table(spark, sf_dir, "events")
    row = lambda kind, failed: F.struct(F.lit(kind).alias("kind"), F.when(failed, A.llm_failure(F.concat(F.lit("status "), F.lit(503).cast("string")))).alias("class"), F.col("value").alias("duration_ms"), F.length("props").alias("tokens"))
    bad = F.col("event_type") == "error"
    ledger = F.when(bad, F.array(row("initial", F.lit(True)), row("retry", F.lit(False)))).otherwise(F.array(row("initial", F.lit(False))))
    return A.attempts(e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("stage"), ledger.alias("ledger")))


def reports_rendered(spark, sf_dir):
    """K4: Markdown and HTML of claims and sources."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").alias("ord"), F.col("text").alias("claim"))
    s = c.groupBy("report_id").agg(F.count("*").alias("n")).select("report_id", F.lit("S1").alias("source_id"), F.lit("t<").alias("title"), F.lit("u").alias("url"))
    return files.report_markdown(c, s).select("report_id", F.md5("markdown").alias("markdown_md5"), F.length("html").alias("html_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        html_body_text, html_content, json_salvage, tool_rows, markdown_sanitised, cited_claims, mock_search, adapter_scores, query_candidates, planned_questions, decisions, research_reports, run_budgets,
        failed_candidates, metadata_defaults, model_probes, attempt_ledger, reports_rendered,
    )
}

_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_MOCK = ", ".join("({}, '{}', '{}', '{}')".format(i, *(x.replace("'", "''") for x in d)) for i, d in enumerate(S.MOCK))
_LANDED = f"""
l AS (SELECT page_id // 12 AS query_id, ['wikipedia', 'bing', 'gateway-web', 'mcp'][CAST(page_id % 4 + 1 AS INT)] AS provider, page_id // 4 % 3 AS ord, {_TITLE} AS title, url, substr({_TITLE}, 5, 40) AS content FROM pages),
o AS (SELECT l.*, len(list_intersect({TOK.format(x='text')}, {TOK.format(x="(title || ' ' || content)")})) AS shared, count(*) OVER (PARTITION BY query_id, provider) AS n FROM l JOIN benchmark ON item_id = query_id WHERE ord < 3),
own AS (SELECT provider AS asked, query_id, ord, url, provider, CASE provider WHEN 'gateway-web' THEN greatest(n - ord - 1, 1) WHEN 'mcp' THEN n - ord WHEN 'wikipedia' THEN 10 * shared + 3 - ord ELSE 8 * shared + 3 - ord END::DOUBLE AS score FROM o)"""
_MOCKED = f"""
m(i, t, u, c) AS (VALUES {_MOCK}),
mk AS (SELECT item_id AS query_id, u AS url, len(list_intersect({TOK.format(x='text')}, {TOK.format(x="(t || ' ' || u || ' ' || c)")})) + 0.1 AS score, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect({TOK.format(x='text')}, {TOK.format(x="(t || ' ' || u || ' ' || c)")})) DESC, i) - 1 AS ord FROM benchmark, m),
mock AS (SELECT * FROM mk WHERE ord < 3)"""

_DEEP = [(q.split("{}"), w, a) for a, q, w in P.DEEP[:3]]
_CONC = [(q.split("{}"), w, a) for a, q, w in P.CONCISE[:3]]
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_PLAN = " UNION ALL ".join(
    f"SELECT run_id, 'Q{k + 1}' AS q, {_lit(q[0])} || t || {_lit(q[1])} AS question, t || ' ' || {_lit(w)} AS search_query, {_lit(a if deep else '')} AS aspects FROM r WHERE deep = {str(deep).lower()}"
    for deep, rows in ((True, _DEEP), (False, _CONC))
    for k, (q, w, a) in enumerate(rows)
)

_BING = "'what is \"exact phrase here\" at www.Example.com ' || text"
_KEYWORDS = lambda x, pattern, stop: f"""list_transform(list_filter(list_transform(list_filter(regexp_extract_all({x}, '{pattern}'),
  lambda w: NOT list_contains({stop}, trim(lower(w), '.')) AND (length(trim(lower(w), '.')) > 2 OR regexp_full_match(trim(lower(w), '.'), '[0-9]+'))), lambda w, i: {{'w': w, 'i': i}}), lambda y:
  coalesce(list_position(list_transform(list_filter(regexp_extract_all({x}, '{pattern}'), lambda w: NOT list_contains({stop}, trim(lower(w), '.')) AND (length(trim(lower(w), '.')) > 2
  OR regexp_full_match(trim(lower(w), '.'), '[0-9]+'))), lambda w: lower(w)), trim(lower(y.w), '.')), y.i) >= y.i), lambda y: y.w)"""  # noqa: E731

ORACLES = {
    "query_candidates": f"""
WITH k AS (SELECT item_id, text, {_KEYWORDS('text', '[A-Za-z][A-Za-z0-9_-]+', S.STOP)} AS w, {_KEYWORDS(_BING, '[A-Za-z0-9][A-Za-z0-9_.-]*', S.STOP + ['who', 'latest', 'current'])} AS b, {_BING} AS q FROM benchmark)
SELECT item_id, array_to_string(list_filter([CASE WHEN len(w) > 0 THEN array_to_string(w[1:8], ' ') END, CASE WHEN len(w) > 4 THEN array_to_string(w[1:4], ' ') END, trim(text)], lambda x: x IS NOT NULL AND x <> ''), '|') AS wikipedia,
  {SQZ.format(x='q')} || '|' || {SQZ.format(x="regexp_replace(array_to_string(b[1:10], ' '), '\\bexample\\.com\\b', '', 'gi')")} || ' site:example.com' || '|"exact phrase here"' AS bing, 'example.com' AS domain FROM k""".replace("\\\\", "\\"),
    "json_salvage": "SELECT conv_id, turn, CASE WHEN conv_id % 4 < 3 THEN role END AS role, conv_id % 4 < 3 AS any_json, 1 AS n_predictions FROM conversations",
    "mock_search": f"WITH {_MOCKED} SELECT query_id, ord, url, round(score, 6) AS score FROM mock",
    "adapter_scores": f"""WITH {_LANDED}, {_MOCKED}, a(asked) AS (VALUES ('wikipedia'), ('bing'), ('gateway-web'), ('mcp')),
p AS (SELECT asked, item_id AS query_id FROM a, benchmark WHERE (asked, item_id) NOT IN (SELECT (asked, query_id) FROM own)),
g AS (SELECT p.asked, p.query_id, ord, url, provider, score FROM p JOIN own ON p.asked = 'gateway-web' AND own.asked = 'bing' AND own.query_id = p.query_id)
SELECT asked, query_id, ord, url, provider, round(score, 6) AS score FROM own UNION ALL SELECT asked, query_id, ord, url, provider, round(score, 6) FROM g
UNION ALL SELECT p.asked, p.query_id, ord, url, 'mock', round(score, 6) FROM p JOIN mock USING (query_id) WHERE (p.asked, p.query_id) NOT IN (SELECT (asked, query_id) FROM g)""",
    "planned_questions": f"""
WITH r AS (SELECT item_id AS run_id, item_id % 2 = 0 AS deep, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t0 FROM benchmark),
s AS (SELECT * FROM (SELECT run_id, deep, regexp_replace(CASE WHEN t0 LIKE '%?' THEN t0 ELSE t0 || '?' END, '\\?+$', '') AS t FROM r)),
p AS ({_PLAN.replace('FROM r ', 'FROM s ')})
SELECT run_id, q, md5(question) AS question_md5, md5(search_query) AS search_md5, aspects, true AS valid FROM p""".replace("\\\\", "\\"),
    "run_budgets": """SELECT item_id AS run_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS max_rounds, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS max_tool_calls,
  CASE WHEN item_id % 3 = 0 THEN 60.0 WHEN item_id % 2 = 0 THEN 300.0 END AS deadline_s, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS min_evidence, CASE WHEN item_id % 2 = 0 THEN 8 ELSE 4 END AS max_results FROM benchmark""",
    "failed_candidates": f"""SELECT DISTINCT md5(trim(regexp_replace(substr(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), 1, 240), '^$', '', 'g'))) AS title_md5, CASE WHEN page_id % 5 = 0 THEN sha256(url) END AS url_identity_sha256,
  CASE WHEN page_id % 5 <> 0 THEN regexp_replace(url, '[?#].*$', '') END AS url, page_id % 10 AS rank, CASE WHEN page_id % 5 = 0 THEN 'blocked' ELSE 'failed' END AS crawl_status,
  CASE WHEN page_id % 5 = 0 THEN 'denylist_enforcement' WHEN page_id % 2 = 0 THEN 'timeout' ELSE 'crawler_error' END AS error_class, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS crawl_attempts
FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0""".replace("\\\\", "\\"),
    "metadata_defaults": """SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'blocked' WHEN trim(text) = '' THEN 'empty' WHEN doc_id % 2 = 0 THEN 'snippet' ELSE 'ok' END AS extract_status,
  CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS snippet_only, 6 AS n FROM documents""",
    "model_probes": """SELECT event_id, event_id % 5 < 2 AS matches, CASE WHEN event_id % 2 > 0 AND event_id % 4 > 0 THEN 'tool_results' WHEN event_id % 2 > 0 THEN 'tool_no_results' WHEN event_id % 3 = 0 THEN 'text_only_no_tool' ELSE 'empty_response' END AS status,
  event_id % 5 < 3 AS self_judge FROM events""",
    "attempt_ledger": """
WITH a AS (SELECT event_id, event_type, 'initial' AS kind, event_type = 'error' AS failed, value, length(props) AS t FROM events UNION ALL SELECT event_id, event_type, 'retry', false, value, length(props) FROM events WHERE event_type = 'error')
SELECT event_type AS stage, kind, count(*) AS n_attempts, count(*) FILTER (WHERE failed) AS n_failed, count(DISTINCT event_id) AS n_calls, round(sum(value), 3) AS duration_ms, CAST(sum(t) AS BIGINT) AS tokens FROM a GROUP BY ALL""",
    "decisions": """
WITH c AS (SELECT conv_id, turn, ['stop', 'DONE', 'search', 'odd', ''][CAST(conv_id % 5 + 1 AS INT)] AS a FROM conversations),
d AS (SELECT *, CASE WHEN a IN ('stop', 'DONE') AND turn >= 2 THEN 'stop' WHEN a IN ('stop', 'DONE') THEN 'short' WHEN a = 'search' THEN 'go' WHEN turn >= 2 THEN 'own_stop' ELSE 'own_go' END AS k FROM c)
SELECT conv_id, turn, CASE WHEN k IN ('stop', 'own_stop') THEN 'stop' ELSE 'need_follow_up' END AS action,
  CASE WHEN k = 'own_stop' THEN 'minimum verified evidence coverage reached' WHEN k = 'own_go' THEN 'verified evidence coverage is below the configured minimum' WHEN turn % 2 = 0 THEN 'why' ELSE 'model returned a decision without an explanation' END AS reason,
  CASE k WHEN 'short' THEN 'need ' || (2 - turn) || ' additional evidence items' WHEN 'go' THEN 'model requested additional evidence' WHEN 'own_go' THEN 'need ' || (2 - turn) || ' additional independent evidence items' END AS gap,
  CASE WHEN k IN ('short', 'go') AND turn % 2 = 1 THEN 'more' WHEN k IN ('short', 'go', 'own_go') THEN 'Q independent primary evidence round 1' END AS follow_up FROM d""",
    "tool_rows": """SELECT page_id, true AS same_url, 't' AS title, CASE WHEN page_id % 2 = 0 THEN 't' ELSE 'line one' || chr(10) || 'line two' END AS content, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS n_urls FROM pages""",
    "reports_rendered": """
WITH b AS (SELECT conv_id AS report_id, '# Report ' || conv_id || chr(10) || chr(10) || string_agg('- ' || text, chr(10) ORDER BY turn) || chr(10) || chr(10) || '## Sources' || chr(10) || '- [S1] t< - u' AS m FROM conversations GROUP BY 1)
SELECT report_id, md5(m) AS markdown_md5, length('<pre>' || replace(replace(replace(m, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre>') AS html_chars FROM b""",
}
