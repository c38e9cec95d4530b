"""The SQL that gives the rows of eval_queries."""

from __future__ import annotations

from corroborate.plans.evidence_queries import _KW
from corroborate.plans.text_queries import SENT, SQZ

_COST = "(CASE WHEN {x} = '' THEN 0 ELSE (length({x}) + 3) // 4 END)"
_RATE = "round(count(*) FILTER (WHERE {x}) / count(*)::DOUBLE, 4)"

_CASES = f"""
d AS (SELECT doc_id AS case_id, lang, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS answer, doc_id % 4 AS total, quality, toxic, n_chars, text FROM documents JOIN labels USING (doc_id)),
e AS (SELECT *, CASE WHEN quality = 1 THEN total ELSE greatest(total - 1, 0) END AS supported, trim(answer) <> '' AS has FROM d),
f AS (SELECT *, has AND total > 0 AS substantive_answer, has AND total > 0 AND supported = total AND case_id % 5 <> 0 AS grounded_answer FROM e),
cases AS (SELECT *, has AS task_format_valid, has AND NOT substantive_answer AS evidence_abstention, has AND grounded_answer AS final_result_usable,
  CASE WHEN total > 0 THEN round((total - supported) / total::DOUBLE, 4) END AS unsupported_claim_rate, round(case_id % 10 / 10.0::DOUBLE, 4) AS source_quality,
  total > 0 AND supported / total::DOUBLE >= 0.8 AND case_id % 3 > 0 AS legacy_success,
  CASE WHEN case_id % 6 = 0 THEN CASE WHEN has AND grounded_answer AND case_id % 2 > 0 THEN 1.0 ELSE 0.0 END END AS tool_failure_recovery,
  CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'correct' ELSE 'not_attempted' END AS verdict,
  n_chars::DOUBLE AS latency_ms, {_COST.format(x='text')} AS tokens, n_chars / 1e6 AS cost FROM f)"""

_MERGED = """
j AS (SELECT d.doc_id AS rubric_id, lang AS category, source AS case_id, coalesce(quality, -1) AS score_a, coalesce(toxic, -1) AS score_b,
  CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id % 7 = 0 END AS sa, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id % 11 = 0 END AS sb FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT *, score_a >= 0 AND score_b >= 0 AND score_a = score_b AS agreement, score_a >= 0 AND score_b >= 0 AND score_a <> score_b AS disagreement, NOT (score_a >= 0 AND score_b >= 0) AS unscored,
  score_a = 1 AND score_b = 1 AS conservative_pass, score_a = 1 AND score_b = 1 AND NOT coalesce(sa, true) AND NOT coalesce(sb, true) AS independent_pass, coalesce(sa, false) OR coalesce(sb, false) AS any_self_judge FROM j)"""

_VERDICTS = """
v AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 13 = 0 THEN 'unscored' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS va,
  CASE WHEN doc_id % 13 = 0 THEN 'unscored' WHEN toxic = 1 THEN 'correct' ELSE 'incorrect' END AS vb, doc_id % 7 = 0 AS sa FROM labels)"""

_RUNS = """
runs AS (SELECT user_id AS run_id, min(ts) AS created, max(ts) AS updated, CASE WHEN arg_max(event_type, event_id) IN ('view', 'signup') THEN 'queued' ELSE 'running' END AS status,
  CASE WHEN count(*) % 2 = 0 THEN 'planner' ELSE 'researcher' END AS stage FROM events GROUP BY 1)"""

# the requests of a run, one step of the recursion each
_FOLD = """
r AS (SELECT user_id AS run_id, event_type AS t, ts, 'w' || event_id % 2 AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT DISTINCT run_id, 0::BIGINT AS n, 'queued' AS status, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS TIMESTAMP) AS expires, 0 AS applied, 0 AS rejected FROM r
  UNION ALL
  SELECT run_id, n, CASE WHEN ok AND t = 'click' THEN 'running' WHEN ok AND t = 'purchase' THEN 'succeeded' ELSE status END,
    CASE WHEN ok AND t IN ('error', 'purchase') THEN NULL WHEN ok AND t IN ('view', 'signup') THEN w ELSE worker END,
    CASE WHEN ok AND t IN ('error', 'purchase') THEN NULL WHEN ok AND t IN ('view', 'signup') THEN ts + INTERVAL 1 HOUR ELSE expires END,
    applied + ok::INT, rejected + (NOT ok)::INT
  FROM (SELECT f.run_id, r.n, f.status, f.worker, f.expires, f.applied, f.rejected, r.t, r.w, r.ts, coalesce(CASE r.t
      WHEN 'view' THEN f.status <> 'succeeded' AND (f.worker IS NULL OR f.expires <= r.ts OR f.worker = r.w) WHEN 'click' THEN f.status = 'queued'
      WHEN 'signup' THEN f.status <> 'succeeded' AND f.worker = r.w WHEN 'error' THEN f.worker = r.w WHEN 'purchase' THEN f.status = 'running' AND f.worker = r.w END, false) AS ok
    FROM f JOIN r ON r.run_id = f.run_id AND r.n = f.n + 1)
),
state AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1)"""

_NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9一-鿿]+', ' ', 'g'))"

ORACLES = {
    "case_metrics": f"WITH {_CASES} SELECT case_id, task_format_valid, substantive_answer, grounded_answer, evidence_abstention, final_result_usable, unsupported_claim_rate, source_quality, legacy_success, tool_failure_recovery FROM cases",
    "eval_summary": f"WITH {_CASES} SELECT lang, count(*) AS case_count, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}_count, {_RATE.format(x=c)} AS {c}_rate" for c in ("task_format_valid", "grounded_answer", "evidence_abstention"))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS answer_{v}_count" for v in ("correct", "incorrect", "not_attempted", "unscored"))
    + ", "
    + _RATE.format(x="verdict = 'correct'")
    + " AS answer_correct_rate, "
    + ", ".join(f"round(avg({c}), 4) AS {c}_avg" for c in ("unsupported_claim_rate", "source_quality", "tool_failure_recovery"))
    + ", count(tool_failure_recovery) AS tool_failure_recovery_applicable_count, quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.9) AS p90_latency_ms, max(latency_ms) AS max_latency_ms,"
    + " round(avg(tokens), 3) AS avg_tokens, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost), 8) AS total_cost_usd FROM cases GROUP BY 1",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS max FROM events GROUP BY 1",
    "cost_rollup": f"""
WITH c AS (SELECT conv_id % 10 AS run_id, role AS stage, CASE WHEN turn % 2 = 0 THEN 'm0' ELSE 'm1' END AS model, {_COST.format(x='text')} AS i, {_COST.format(x='(role || text)')} AS o FROM conversations),
k AS (SELECT *, round(i * 0.14 / 1000000 + o * 0.28 / 1000000, 8) AS cost FROM c)
SELECT run_id, stage, model, CAST(grouping(run_id, stage, model) AS INT) AS level, CAST(sum(i + 1) AS BIGINT) AS total_input_tokens, CAST(sum(o) AS BIGINT) AS total_output_tokens,
  CAST(sum(i + 1) + sum(o) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS total_cost_usd FROM k GROUP BY ROLLUP (run_id, stage, model)""",
    "usage_cost": """
WITH u AS (SELECT event_id, event_id % 3 AS m, event_id % 1000 AS p, event_id % 7 AS c, event_id % 50 AS h, CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS x FROM events),
e AS (SELECT *, CASE WHEN p <= 0 OR c <= 0 THEN 'usage has no token counts' WHEN m = 2 THEN 'no price for this model' END AS error FROM u)
SELECT event_id, error, CASE WHEN error IS NULL THEN round((h * (0.01 * (m + 1)) + coalesce(x, greatest(p - h, 0)) * (0.1 * (m + 1)) + c * (0.4 * (m + 1))) / 1000000.0::DOUBLE, 9) END AS cost_usd FROM e""",
    "crawl_errors": """
WITH x AS (SELECT user_id % 50 AS run_id, event_id, event_type, ['timeout', 'http_429', 'http_5xx', 'http_4xx', 'connection_failure', 'empty_content', 'crawler_error'][CAST(event_id % 7 + 1 AS INT)] AS e FROM events WHERE event_type IN ('error', 'view')),
h AS (SELECT run_id, '{' || string_agg('"' || e || '":' || n, ',' ORDER BY e) || '}' AS error_classes FROM (SELECT run_id, e, count(*) AS n FROM x WHERE event_type = 'error' GROUP BY ALL) GROUP BY 1)
SELECT run_id, count(*) AS candidate_count, count(*) FILTER (WHERE event_id % 4 <> 0) AS fetchable_count, count(*) FILTER (WHERE event_type = 'view') AS verified_count, CAST(sum(event_id % 3) AS BIGINT) AS crawl_attempts,
  coalesce(any_value(error_classes), '{}') AS error_classes, count(*) FILTER (WHERE event_id % 100 = 0) AS blocked_count, count(*) FILTER (WHERE event_id % 100 = 0) > 0 AS denylist_enforcement_hit FROM x LEFT JOIN h USING (run_id) GROUP BY 1""",
    "distributions": "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2",
    "answer_judge": rf"""
WITH {_KW}, x AS (SELECT query_id, doc_id, b.text AS q, d.text AS answer FROM kw JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)),
w AS (SELECT *, regexp_replace(string_split(q, ' ')[2], '[^\p{{L}}]', '', 'g') AS a, regexp_replace(string_split(q, ' ')[7], '[^\p{{L}}]', '', 'g') AS b, {_NORM.format(x='answer')} AS n FROM x),
h AS (SELECT *, {_NORM.format(x='a')} AS na, {_NORM.format(x='b')} AS nb FROM w)
SELECT query_id, doc_id, CASE WHEN trim(answer) = '' THEN 'not_attempted' WHEN na <> '' AND contains(n, na) AND (query_id % 3 <> 0 OR (nb <> '' AND contains(n, nb)) OR contains(n, 'zzz')) THEN 'correct' ELSE 'incorrect' END AS verdict FROM h""",
    "dual_judge_merge": f"WITH {_MERGED} SELECT rubric_id, score_a, score_b, agreement, disagreement, unscored, conservative_pass, independent_pass, any_self_judge FROM m",
    "rubric_grouping_sets": f"WITH {_MERGED} SELECT category, case_id, CAST(grouping(category, case_id) AS INT) AS level, count(*) AS rubric_count, "
    + ", ".join(
        f"count(*) FILTER (WHERE score_{s} = 1) AS ones_{s}, count(*) FILTER (WHERE score_{s} = 0) AS zeros_{s}, count(*) FILTER (WHERE score_{s} = -1) AS unscored_{s}, {_RATE.format(x=f'score_{s} = 1')} AS rate_fixed_{s},"
        f" CASE WHEN count(*) FILTER (WHERE score_{s} >= 0) > 0 THEN round(count(*) FILTER (WHERE score_{s} = 1) / (count(*) FILTER (WHERE score_{s} >= 0))::DOUBLE, 4) END AS rate_scored_{s}"
        for s in "ab"
    )
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}_count, {_RATE.format(x=f)} AS {f}_rate" for f in ("agreement", "disagreement", "unscored", "conservative_pass", "independent_pass"))
    + " FROM m GROUP BY GROUPING SETS ((category), (case_id), ())",
    "judge_agreement": f"""WITH {_VERDICTS} SELECT case_id, va <> 'unscored' AS all_judges_scored, CASE WHEN va <> 'unscored' AND va = vb THEN va END AS unanimous_verdict, va = 'correct' AND vb = 'correct' AS dual_correct,
  va = 'correct' AND vb = 'correct' AND NOT sa AS independent_dual_correct, sa AS any_self_judge, va = 'unscored' OR va <> vb OR sa AS manual_review FROM v""",
    "judge_summary": f"""WITH {_VERDICTS}, t AS (SELECT 'a' AS judge, va AS verdict, sa AS self FROM v UNION ALL SELECT 'b', vb, false FROM v)
SELECT judge, count(*) AS fixed_denominator, """
    + ", ".join(f"count(*) FILTER (WHERE verdict = '{x}') AS {x}_count" for x in ("correct", "incorrect", "not_attempted", "unscored"))
    + f", {_RATE.format(x=chr(39).join(('verdict = ', 'correct', '')))} AS correct_rate, count(*) FILTER (WHERE self) AS self_judge_count FROM t GROUP BY 1",
    "rubric_attempts": """
WITH l AS (SELECT doc_id, CASE WHEN (doc_id + doc_id % 3 + 1) % 4 = 0 THEN -1 ELSE quality END AS score FROM labels),
p AS (SELECT d.doc_id AS rubric_id, lang AS case_id FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id AND score <> -1 WHERE l.doc_id IS NULL)
SELECT rubric_id, case_id, CAST((row_number() OVER (PARTITION BY case_id ORDER BY rubric_id) - 1) // 50 AS INT) AS batch FROM p""",
    "rubric_specs": f"""
WITH s AS (SELECT CAST(item_id AS VARCHAR) AS id, {SENT.format(x='text')} AS s FROM benchmark),
k AS (SELECT id AS case_id, 'info_recall' AS category, unnest(range(0, len(s[1:2]))) AS rubric_index, s FROM s UNION ALL SELECT id, 'analysis', 0, s[2:] FROM s WHERE len(s) >= 2 UNION ALL SELECT id, 'presentation', unnest(range(0, len(s) - 2)), s[3:] FROM s WHERE len(s) >= 3)
SELECT case_id, category, rubric_index, case_id || ':' || category || ':' || rubric_index AS rubric_id, sha256(s[rubric_index + 1]) AS rubric_sha256 FROM k""",
    "stratum_ranks": "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('7:' || source || ':' || doc_id)) AS r FROM documents QUALIFY r <= 3",
    "excluded_candidates": f"SELECT item_id FROM benchmark WHERE {SQZ.format(x='lower(text)')} NOT IN (SELECT {SQZ.format(x=f'lower(coalesce({SENT.format(x=chr(116) + chr(101) + chr(120) + chr(116))}[1], {chr(39) * 2}))')} FROM documents)",
    "replay_set_diff": """
WITH l AS (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000000 ELSE 0 END AS case_id FROM labels)
SELECT doc_id AS case_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT case_id FROM l) UNION ALL SELECT case_id, 'extra' FROM l WHERE case_id NOT IN (SELECT doc_id FROM documents)""",
    "contract_check": """SELECT doc_id AS case_id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'lang' END, NULL, CASE WHEN doc_id % 8 = 1 THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS drift FROM documents""",
    "cassette_inventory": """SELECT kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS operations FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'llm' END AS kind, event_type FROM events) GROUP BY 1""",
    "cassette_replay": """SELECT event_id % 7 <> 3 AND event_id % 10 <> 0 AS matches, event_id % 7 <> 3 AS played, count(*) AS n FROM events GROUP BY ALL""",
    "case_hashes": """SELECT item_id, sha256('{"item_id":' || item_id || ',"text":' || to_json(text) || '}') AS sha, 'case-' || substr(sha256(CAST(item_id AS VARCHAR)), 1, 12) AS ref FROM benchmark""",
    "judge_identities": """
WITH f AS (SELECT conv_id, lower(role) AS provider, 'm' || turn % 2 AS model, min(turn) AS first FROM conversations GROUP BY ALL)
SELECT conv_id, provider, model, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS place FROM f""",
    "run_state_fold": f"WITH RECURSIVE {_FOLD} SELECT run_id, status, worker, applied, rejected, strftime(expires, '%Y-%m-%d %H:%M:%S') AS expires FROM state",
    "stale_runs": f"WITH RECURSIVE {_FOLD} SELECT run_id, strftime(expires, '%Y-%m-%d %H:%M:%S') AS expires FROM state WHERE status = 'running' AND expires <= (SELECT max(ts) FROM events)",
    "next_queued": f"WITH {_RUNS} SELECT run_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT * FROM runs WHERE status = 'queued' AND stage = 'planner' ORDER BY created, updated, run_id LIMIT 1)",
    "recent_runs": f"WITH {_RUNS} SELECT run_id, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated FROM (SELECT * FROM runs ORDER BY updated DESC, created DESC, run_id LIMIT 20)",
    "event_tail": "SELECT event_id, 1 AS attempt, event_type = 'error' AS retryable, false AS degraded FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)",
    "trace_totals": f"""WITH {_RUNS} SELECT run_id, round((epoch_us(updated) - epoch_us(created)) / 1000.0::DOUBLE, 3) AS latency_ms, next_retry
FROM runs JOIN (SELECT user_id AS run_id, greatest(0, coalesce(max(CAST(json_extract(props, '$.k') AS INT)) FILTER (WHERE event_type = 'error'), 0)) + 1 AS next_retry FROM events GROUP BY 1) USING (run_id)""",
    "circuit_breaker": """
WITH RECURSIVE r AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS n, 0 AS failures, CAST(NULL AS DOUBLE) AS opened, 0 AS passed, 0 AS refused FROM r
  UNION ALL
  SELECT key, n, CASE WHEN pass AND ok THEN 0 ELSE x END, CASE WHEN pass AND ok THEN NULL WHEN pass AND x >= 2 THEN t WHEN cooled THEN NULL ELSE opened END, passed + pass::INT, refused + (NOT pass)::INT
  FROM (SELECT *, CASE WHEN cooled THEN 0 ELSE failures END + (pass AND NOT ok)::INT AS x
    FROM (SELECT f.key, r.n, failures, opened, passed, refused, t, ok, opened IS NOT NULL AND t - opened >= 86400 AS cooled, opened IS NULL OR t - opened >= 86400 AS pass FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
)
SELECT key, passed, refused, opened IS NOT NULL AS open FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""",
    "rate_limiter": """
WITH e AS (SELECT user_id AS key, event_id AS ord, epoch_us(ts) / 1e6 AS at_s, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 3600.0::DOUBLE AS lead FROM events)
SELECT key, ord, round(max(at_s - lead) OVER (PARTITION BY key ORDER BY ord ROWS UNBOUNDED PRECEDING) + lead, 3) AS start FROM e""",
    "otlp_spans": """SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 32) AS trace_id, substr(sha256(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), 1, 16) AS span_id,
  greatest(epoch_us(ts) * 1000 - CAST(floor(greatest(coalesce(value, 0), 0) * 1000000) AS BIGINT), 0) AS start_ns, epoch_us(ts) * 1000 AS end_ns, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS code FROM events""",
    "gold_sources": f"""WITH {_KW}, g AS (SELECT kw.*, contains(lower({SQZ.format(x='d.text')}), lower({SQZ.format(x='b.text')})) AS gold, doc_id % 4 <> 0 AS citable FROM kw JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))
SELECT query_id, bool_or(gold) AS retrieved, bool_or(gold AND citable) AS cited, count(*) FILTER (WHERE citable) AS n_citable FROM g GROUP BY 1""",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
}
